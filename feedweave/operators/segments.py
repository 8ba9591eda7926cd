"""Segmentation and ranking over the node relation: semantic containers, link lists, clusters, primary links, scores.

Everything is relational on (page_id, node_id, last_desc). What lies inside what is told by sweeps over a page in document
order (windows): the next heading or container from an element on lies in it if it comes before the element's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import destinations, texts, urls
from feedweave.functions import lexicon as L
from feedweave.sources.shared import by_merge, written

#: Columns of the node relation that lists of links need; those that containers and their links need.
LISTED = ("page_id", "node_id", "last_desc", "tag", "tag_path", "href", "visible_text", "chrome", "is_link", "landmark_id", "boundary_id")
CONTAINED = (*LISTED, "depth", "non_leaf", "is_heading")
CONTAINERS = ("article", "section", "li", "tr", "div")


def _page(*order: Column):
    return Window.partitionBy("page_id").orderBy(*order)


def _ahead(*, own: bool) -> Window:
    return Window.partitionBy("page_id").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def semantic(nodes: DataFrame) -> DataFrame:
    """page_id, root_id, last_desc, tag, depth, position: leaf containers outside chrome, deepest first; those around other containers than div do not count."""
    leaf = nodes.where(F.col("tag").isin(*CONTAINERS) & ~F.col("chrome") & ~F.col("non_leaf")).select("page_id", "node_id", "last_desc", "tag", "depth")
    inner = F.min(F.when(F.col("tag") != "div", F.col("node_id"))).over(_ahead(own=False))
    kept = leaf.withColumn("_inner", inner).where(F.col("_inner").isNull() | (F.col("_inner") > F.col("last_desc")))
    return kept.select("page_id", F.col("node_id").alias("root_id"), "last_desc", "tag", "depth", (F.row_number().over(_page(F.desc("depth"), F.col("node_id"))) - 1).alias("position"))


def linked(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with their label, url, facts f, and icon: no words, but an image inside."""
    image = F.min(F.when(F.col("tag").isin("img", "svg"), F.col("node_id"))).over(_ahead(own=True))
    links = nodes.select("page_id", "node_id", "last_desc", "tag_path", "chrome", "landmark_id", "boundary_id", "href", F.col("visible_text").alias("label"), "is_link", image.alias("_image")).where("is_link")
    links = links.join(by_merge(pages.select("page_id", F.col("url").alias("_base"))), "page_id")
    links = links.withColumn("url", urls.resolve(F.trim(F.regexp_replace("href", "#.*$", "")), F.col("_base")))
    icon = (texts.word_count(F.col("label")) == 0) & F.coalesce(F.col("_image") <= F.col("last_desc"), F.lit(False))
    return links.withColumns({"f": destinations.facts(F.col("url")), "icon": icon}).drop("is_link", "_image", "_base")


def link_lists(nodes: DataFrame, minimum: int = 2, top: int = 5) -> DataFrame:
    """page_id, tag_path, links: anchor paths that occur at least minimum times, the top ones per page."""
    paths = nodes.where("is_link").groupBy("page_id", "tag_path").agg(F.count("*").alias("links"), F.min("node_id").alias("first_id")).where(F.col("links") >= minimum)
    ranked = paths.withColumn("rank", F.row_number().over(_page(F.desc("links"), F.col("first_id"))))
    return ranked.where(F.col("rank") <= top).select("page_id", "tag_path", "links", "rank")


def list_segments(nodes: DataFrame, minimum: int = 2, top: int = 5, pages: DataFrame | None = None) -> DataFrame:
    """page_id, root_id, link_id, position: each listed anchor stands for the last element around it before one with more links.

    Anchors in chrome do not count, nor, where pages (page_id, url) are given, those that are noise.
    """
    links = nodes.where("is_link and not chrome").select("page_id", "node_id", "tag_path", "boundary_id", "is_link")
    if pages is not None:
        no = F.lit(False)
        heard = linked(nodes, pages).where(~F.col("chrome") & ~destinations.noise_anchor(F.col("label"), F.col("f"), no, F.col("icon"), no))
        links = written(links.join(by_merge(heard.select("page_id", "node_id")), ["page_id", "node_id"], "left_semi"), "links")
    found = links.join(by_merge(link_lists(links, minimum, top).select("page_id", "tag_path", "rank")), ["page_id", "tag_path"]).where("boundary_id is not null")
    one = found.groupBy("page_id", F.col("boundary_id").alias("root_id")).agg(F.min(F.struct("rank", F.col("node_id").alias("link_id"))).alias("_l"))
    return one.select("page_id", "root_id", "_l.link_id", (F.row_number().over(_page(F.col("_l.rank"), F.col("_l.link_id"))) - 1).alias("position"))


def primary_links(nodes: DataFrame, segments: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, root_id, link_id, href, url, points: of a segment's anchors that are no noise the best of each target, of these the best.

    segments (page_id, root_id, last_desc, tag): divs do not nest, nor do the others, so a link lies in the last of either
    kind before it or in none. Equals: the earliest anchor of a target, the target that comes first.
    """
    nested = F.col("tag") == "div" if "tag" in segments.columns else F.lit(False)
    starts = nodes.select("page_id", "node_id", F.min(F.when(F.col("is_heading"), F.col("node_id"))).over(_ahead(own=True)).alias("heading_id"))
    heads = nodes.where("is_heading").select("page_id", F.col("node_id").alias("heading_id"), F.col("last_desc").alias("heading_last"), F.trim("visible_text").alias("heading"))
    roots = segments.select("page_id", F.col("root_id").alias("node_id"), "last_desc", nested.alias("nested")).join(by_merge(starts), ["page_id", "node_id"])
    roots = roots.withColumn("heading_id", F.when(F.col("heading_id") <= F.col("last_desc"), F.col("heading_id"))).join(by_merge(heads), ["page_id", "heading_id"], "left")
    root = F.struct(F.col("node_id").alias("root_id"), "last_desc", "heading_id", "heading_last", "heading")
    links = linked(nodes, pages).where(~F.col("chrome")).select("page_id", "node_id", F.struct("landmark_id", "href", F.trim("label").alias("label"), "url", "f", "icon").alias("link"))
    both = roots.select("page_id", "node_id", "nested", root.alias("root")).unionByName(links, allowMissingColumns=True)
    # a segment that is a link itself comes before it
    order = Window.partitionBy("page_id").orderBy("node_id", F.col("link").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("nested") == kind, F.col("root")), ignorenulls=True).over(order) for kind in (False, True)]
    pair = both.withColumn("_in", F.array(*last)).where("link is not null").select("page_id", F.col("node_id").alias("link_id"), "link.*", F.explode("_in").alias("r"))
    pair = pair.where("r is not null and link_id <= r.last_desc").select("*", "r.*").drop("r")
    is_head = F.col("heading_id").isNotNull() & (F.col("link_id") >= F.col("heading_id")) & (F.col("link_id") <= F.col("heading_last"))
    said, content = texts.word_count(F.col("label")) >= 1, F.col("f.content_path")
    noise = destinations.noise_anchor(F.col("label"), F.col("f"), is_head, F.col("icon"), F.col("landmark_id") > F.col("root_id"))
    points = F.when(is_head, 100).otherwise(0) + F.when(said & (F.col("heading") == F.col("label")), 20).otherwise(0) + F.when(said, 10).otherwise(0) + F.when(content, 10).otherwise(0)
    found = pair.withColumns({"_head": is_head, "points": points, "_noise": noise}).where(~F.col("_noise") & (said | content | F.col("_head")))
    target = Window.partitionBy("page_id", "root_id", "url")
    found = found.withColumns({"_k": F.row_number().over(target.orderBy(F.desc("points"), "link_id")), "_seen": F.min("link_id").over(target)}).where("_k = 1")
    best = found.withColumn("_k", F.row_number().over(Window.partitionBy("page_id", "root_id").orderBy(F.desc("points"), "_seen"))).where("_k = 1")
    return best.select("page_id", "root_id", "link_id", "href", "url", "points")


def observation(title: Column, f: Column, path: Column, marker: Column, context: Column, article: Column, tokens: Column) -> Column:
    """Struct of the ranking features of a segment."""
    words = texts.word_count(title)

    def token(words_: list[str]) -> Column:
        return F.regexp_like(tokens, F.lit(rf"(?i)(?:^|\s|[-_])({'|'.join(words_)})(?:\s|[-_]|$)"))

    return F.struct(
        words.alias("words"), F.length(F.coalesce(path, F.lit(""))).alias("path_length"), F.coalesce(f["content_path"], F.lit(False)).alias("content_path"), marker.alias("marker"), context.alias("context"), article.alias("article"),
        token(L.CONTENT).alias("content_tokens"), token(L.UTILITY).alias("junk_tokens"), texts.utility_prefix(title).alias("prefix"), texts.recommended(title).alias("recommended"),
        F.coalesce(f["utility_path"], F.lit(False)).alias("utility_path"), F.coalesce(f["strong_post_suffix"], F.lit(False)).alias("suffix"), F.coalesce(f["shallow"], F.lit(False)).alias("shallow"),
        F.coalesce(f["high_confidence_junk_path"], F.lit(False)).alias("junk_path"), F.coalesce(f["high_confidence_utility_destination"], F.lit(False)).alias("utility_destination"),
    )


def features(o: Column) -> tuple[dict[str, tuple[Column, int]], dict[str, tuple[Column, int]]]:
    """Quality and junk features of an observation by name: test and points."""
    quality = {
        "title_3_words": o["words"] >= 3, "title_7_words": o["words"] >= 7, "long_path": o["path_length"] > 6, "content_path": o["content_path"], "publish_marker": o["marker"],
        "descriptive_context": o["context"], "article_container": o["article"], "content_tokens": o["content_tokens"],
    }
    junk = {
        "utility_path": o["utility_path"] & ~o["content_path"] & ~o["suffix"], "utility_prefix_title": o["prefix"] & (o["words"] <= 6), "shallow": o["shallow"],
        "no_marker_or_context": ~o["marker"] & ~o["context"], "recommended_off_content": o["recommended"] & ~o["content_path"], "junk_path": o["junk_path"], "junk_tokens": o["junk_tokens"],
    }
    return {k: (t, L.QUALITY_POINTS[k]) for k, t in quality.items()}, {k: (t, L.JUNK_POINTS[k]) for k, t in junk.items()}


def score(o: Column) -> tuple[Column, Column]:
    """Quality and junk points of an observation; their difference ranks."""

    def total(named: dict[str, tuple[Column, int]]) -> Column:
        out = F.lit(0)
        for test, points in named.values():
            out = out + F.when(test, points).otherwise(0)
        return out

    quality, junk = features(o)
    return total(quality), total(junk)


def breakdown(o: Column) -> Column:
    """Points by feature, of those that hold."""
    quality, junk = features(o)
    pairs = [x for name, (test, points) in (quality | junk).items() for x in (F.lit(name), F.when(test, points))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def hard_junk(o: Column, anchored: Column, *, strict: bool = True) -> Column:
    signals = o["article"].cast("int") + o["marker"].cast("int") + o["context"].cast("int") + o["content_path"].cast("int")
    weak = signals < 2
    chrome = anchored & weak & ((o["recommended"] & o["shallow"]) | (o["prefix"] & o["utility_destination"]))
    return (o["junk_path"] if strict else o["junk_path"] & weak) | chrome


def rank_top(scored: DataFrame, limit: int = 99) -> DataFrame:
    """Segments of non-negative score by score, then position; limit per page."""
    ranked = scored.where("score >= 0").withColumn("rank", F.row_number().over(_page(F.desc("score"), F.col("position"))))
    return ranked.where(F.col("rank") <= limit)


def first_eligible(scored: DataFrame, limit: int = 99) -> DataFrame:
    """The first segments of each page in page order, whatever their score."""
    ranked = scored.withColumn("rank", F.row_number().over(_page(F.col("position"))))
    return ranked.where(F.col("rank") <= limit)
