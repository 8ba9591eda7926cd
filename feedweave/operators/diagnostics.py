"""What was seen on a page and what to do next, as columns.

A summary is one row a page: aggregates of the node relation, of segments, of candidate articles and of captured responses,
joined by page; samples are the first SAMPLE rows of each, taken before anything is gathered. An outcome is one CASE over such
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import texts, urls
from feedweave.operators import discovery, policy, segments, structured
from feedweave.operators.admission import tallies
from feedweave.sources.shared import by_merge

SAMPLE = 5
#: Columns of the node relation that a summary needs.
NODES = ("page_id", "node_id", "last_desc", "tag", "tag_path", "href", "chrome", "is_link", "boundary_id", "degraded", "all_attributes")
#: The next steps there are.
STEPS = ("done", "inspect_url", "validate_config", "apply_config", "scrape_url", "capture_config", "read_runtime")
GUIDANCE = {
    "done": "Nothing is left to do; the payload holds the result.",
    "inspect_url": "Look at the page first: its address, status and native feeds.",
    "validate_config": "Validate the configuration.",
    "apply_config": "Apply the configuration and check its number of items.",
    "scrape_url": "Scrape the page; the automatic plan tries all transports.",
    "capture_config": "Capture a configuration that can be used again.",
    "read_runtime": "Read the runtime; no rendering transport is set up.",
}


def samples(rows: DataFrame, by: str, order: list[str], what: str, into: str, most: int = SAMPLE) -> DataFrame:
    """by and the first values of a column in order, as an array of at most `most`; rows beyond are dropped before they are gathered."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = rows.withColumn("_k", place).where(F.col("_k") <= most)
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(what).alias("_v")))), lambda x: x["_v"]).alias(into))


def redacted(url: Column) -> Column:
    """Scheme, host and path of an address; null without a scheme and a host."""
    scheme, host = urls.part(url, "scheme"), urls.part(url, "host")
    return F.when(scheme.isNotNull() & (host != ""), F.concat(scheme, F.lit("://"), host, F.coalesce(urls.part(url, "path"), F.lit(""))))


def capture_summary(captures: DataFrame) -> DataFrame:
    """feed_id, count, sample_endpoints, candidate_articles of captured responses (feed_id, position, url, body)."""
    counts = captures.groupBy("feed_id").agg(F.count("*").alias("count"))
    shown = samples(captures, "feed_id", ["position"], "url", "_urls")
    endpoints = shown.select("feed_id", F.filter(F.transform("_urls", redacted), lambda u: u.isNotNull()).alias("sample_endpoints"))
    found = structured.captured(captures).select("feed_id").distinct().withColumn("candidate_articles", F.lit(True))
    return counts.join(endpoints, "feed_id", "left").join(found, "feed_id", "left").withColumn("candidate_articles", F.coalesce("candidate_articles", F.lit(False)))


def summary(pages: DataFrame, nodes: DataFrame, articles: DataFrame | None = None, drops: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """A row for each page (page_id, url, final_url, status, content_type, html) with its node relation NODES.

    html_response, scheme_downgrade, node_count, degraded, segments (found list segments), sample_paths, alternate_feeds,
    blocked_surface; with articles (feed_id, scraper) also articles_count and readers in the given order, with drops
    (feed_id, reason) also admission_drops.
    """
    counts = nodes.groupBy("page_id").agg(F.count("*").alias("node_count"), F.bool_or("degraded").alias("degraded"))
    listed = segments.list_segments(nodes).join(by_merge(nodes.select("page_id", F.col("node_id").alias("root_id"), "tag_path")), ["page_id", "root_id"])
    found = listed.groupBy("page_id").agg(F.count("*").alias("segments"))
    paths = samples(listed, "page_id", ["position"], "tag_path", "sample_paths")
    links = discovery.alternate_feeds(nodes).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "href", "mime_type"))).alias("alternate_feeds"))
    html = F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html"))
    facts = pages.select("page_id", "url", "final_url", "status", html.alias("html_response"), F.coalesce(policy.downgrade(F.col("final_url"), F.col("url")), F.lit(False)).alias("scheme_downgrade"), texts.interstitial(F.col("html")).alias("blocked_surface"))
    out = facts
    for each in (counts, found, paths, links):
        out = out.join(by_merge(each), "page_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"segments": F.coalesce("segments", F.lit(0).cast("long")), "sample_paths": F.coalesce("sample_paths", none), "alternate_feeds": F.coalesce(F.transform("alternate_feeds", lambda x: F.struct(x["href"].alias("href"), x["mime_type"].alias("mime_type"))), F.array().cast("array<struct<href:string,mime_type:string>>"))})
    if articles is not None:
        n = articles.groupBy(F.col("feed_id").alias("page_id")).agg(F.count("*").alias("articles_count"))
        out = out.join(by_merge(n), "page_id", "left").withColumn("articles_count", F.coalesce("articles_count", F.lit(0).cast("long")))
        if order:
            readers = discovery.eligible_readers(articles, order).withColumnRenamed("feed_id", "page_id")
            out = out.join(by_merge(readers), "page_id", "left").withColumn("readers", F.coalesce("readers", none))
    if drops is not None:
        out = out.join(tallies(drops, "feed_id", "reason").select(F.col("feed_id").alias("page_id"), F.col("tallies").alias("admission_drops")), "page_id", "left")
    return out


def _outcome(ok: Column, step: Column) -> Column:
    told = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    return F.struct(ok.alias("ok"), step.alias("next_step"), told[step].alias("guidance"))


def inspect_outcome(alternate_feeds: Column, articles_count: Column) -> Column:
    """A page with native feeds needs nothing more, one with articles a configuration, others a scrape."""
    step = F.when(F.size(alternate_feeds) > 0, "done").when(F.coalesce(articles_count, F.lit(0)) > 0, "capture_config").otherwise("scrape_url")
    return _outcome(F.lit(True), step)


def scrape_outcome(items: Column, renderer: Column) -> Column:
    """renderer: whether a rendering transport is set up."""
    return _outcome(F.lit(True), F.when(items > 0, "done").when(~renderer, "read_runtime").otherwise("inspect_url"))


def capture_outcome(articles_count: Column, selector: Column) -> Column:
    return _outcome(F.lit(True), F.when((articles_count > 0) & selector.isNotNull(), "validate_config").otherwise("inspect_url"))


def validate_outcome(errors: Column) -> Column:
    """errors: an array of problems; null or empty is success."""
    ok = F.coalesce(F.size(errors), F.lit(0)) <= 0
    return _outcome(ok, F.when(ok, "apply_config").otherwise("validate_config"))


def apply_outcome(items: Column) -> Column:
    ok = F.coalesce(items, F.lit(0)) > 0
    return _outcome(ok, F.when(ok, "done").otherwise("inspect_url"))


#: The steps that follow from errors by kind; others ask for a look at the page.
ERROR_STEPS = {"renderer_not_configured": "read_runtime", "unpublished_request": "validate_config", "config_and_yaml": "validate_config"}


def error_outcome(kind: Column) -> Column:
    step = None
    for name, then in ERROR_STEPS.items():
        step = (F if step is None else step).when(kind == name, then)
    return _outcome(F.lit(False), step.otherwise("inspect_url"))


def envelope(outcome: Column, payload: Column) -> Column:
    """An outcome and its payload (a struct) as JSON."""
    return F.to_json(F.struct(outcome["ok"].alias("ok"), outcome["next_step"].alias("next_step"), outcome["guidance"].alias("guidance"), payload.alias("payload")))
