"""Facts about link targets, as column expressions over path segments, and the noise test for anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import lexicon as L
from feedweave.functions import texts, urls
from feedweave.functions.texts import let


def _in(words: list[str]):
    """Whether a segment is one of the words; the list is one constant, not a literal a word."""
    return lambda s: F.array_contains(F.split(F.lit(" ".join(words)), " "), s)


def _like(pattern: str):
    return lambda s: F.regexp_like(s, F.lit(pattern))


_content, _vanity, _utility, _taxonomy = _in(L.CONTENT), _in(L.VANITY), _in(L.UTILITY), _in(L.TAXONOMY)
_yearish = _like(L.YEARISH)


def junk_segment(s: Column) -> Column:
    return _in(L.HIGH_JUNK)(s) | (_like(L.HOST_SHAPED)(s) & ~_like(L.FILE_EXTENSION)(s))


def facts(url: Column) -> Column:
    """Struct of path facts of an absolute URL; null for null."""
    def build(p: Column) -> Column:
        n = F.size(p)
        junk = F.transform(p, junk_segment)
        return let(F.struct(p.alias("p"), junk.alias("junk"), n.alias("n")), _facts)

    return F.when(url.isNotNull(), let(urls.path_segments(url), build))


def _facts(x: Column) -> Column:
    """The facts in three steps, each bound once: what the segments are, what follows for the address, the verdicts."""
    p, junk, n = x["p"], x["junk"], x["n"]
    last, before_last = F.get(p, n - 1), F.slice(p, 1, F.greatest(n - 1, F.lit(0)))
    seen = F.struct(
        n.alias("n"),
        F.exists(junk, lambda j: j).alias("any_junk"),
        F.forall(junk, lambda j: j).alias("all_junk"),
        F.coalesce(F.get(junk, F.lit(0)), F.lit(False)).alias("lead"),
        F.coalesce(F.get(junk, n - 1), F.lit(False)).alias("last_junk"),
        ((n > 1) & F.forall(F.slice(junk, 1, F.greatest(n - 1, F.lit(0))), lambda j: j)).alias("deep"),
        F.exists(before_last, lambda s: _content(s) | _yearish(s) | _in(L.DEEP_POST_CONTEXT)(s)).alias("context"),
        (~_vanity(last) & (_yearish(last) | _like(L.POST_SLUG)(last))).alias("post"),
        *[F.exists(p, test).alias(name) for name, test in (("content", _content), ("year", _yearish), ("utility", _utility), ("vanity", _vanity), ("taxonomy", _taxonomy))],
    )

    def address(s: Column) -> Column:
        trusted = (s["n"] > 1) & ~s["lead"] & s["context"]
        suffix = F.coalesce((s["n"] > 0) & ~s["last_junk"] & s["post"] & trusted, F.lit(False))
        shallow = (s["n"] <= 1) | ((s["n"] == 2) & s["last_junk"])
        return let(F.struct(s.alias("s"), trusted.alias("trusted"), suffix.alias("suffix"), shallow.alias("shallow")), content)

    def content(t: Column) -> Column:
        s = t["s"]
        told = ~s["lead"] & (s["content"] | (s["year"] & (t["suffix"] | t["trusted"])))
        return let(F.struct(s.alias("s"), t["suffix"].alias("suffix"), t["shallow"].alias("shallow"), told.alias("content")), verdicts)

    def verdicts(t: Column) -> Column:
        s = t["s"]
        free = ~((s["n"] == 0) | t["content"] | t["suffix"])
        both = s["taxonomy"] | s["all_junk"] | s["deep"]
        return F.struct(
            t["content"].alias("content_path"),
            s["utility"].alias("utility_path"),
            s["vanity"].alias("vanity_path"),
            s["taxonomy"].alias("taxonomy_path"),
            t["shallow"].alias("shallow"),
            t["suffix"].alias("strong_post_suffix"),
            (free & (s["any_junk"] | both | (t["shallow"] & s["vanity"]))).alias("high_confidence_junk_path"),
            (free & (s["vanity"] | both | (t["shallow"] & s["utility"]))).alias("high_confidence_utility_destination"),
        )

    return let(seen, address)


def noise_anchor(text: Column, f: Column, heading_anchor: Column, icon_only: Column, in_landmark: Column) -> Column:
    short = f["utility_path"] & ~f["content_path"] & ~f["strong_post_suffix"] & (texts.word_count(text) <= 3)
    recommended = ~heading_anchor & texts.recommended(text) & f["shallow"]
    labelled = ~f["content_path"] & texts.utility(text) & ~heading_anchor & ~f["strong_post_suffix"]
    noisy = (
        f["taxonomy_path"]
        | short
        | recommended
        | (texts.utility_prefix(text) & f["high_confidence_utility_destination"])
        | (texts.utility(text) & f["vanity_path"])
        | labelled
        | icon_only
        | in_landmark
    )
    return F.when(f.isNull(), F.lit(True)).otherwise(noisy)
