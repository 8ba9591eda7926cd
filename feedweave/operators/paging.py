"""Follow-up pages: URLs of each pager, joins with the response store, paging as bounded rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.dom import css
from feedweave.dom.tree import parse
from feedweave.functions import urls
from feedweave.functions.urls import resolved
from feedweave.operators import shred, xpath
from feedweave.sources.shared import written


def page_url(url: Column, page: Column, param: str = "page", token: str = "{page}") -> Column:
    """The URL of a page number: the token replaced if the URL holds it, else a query value."""
    return F.when(F.instr(url, token) > 0, F.replace(url, F.lit(token), page.cast("string"))).otherwise(urls.with_query_value(url, param, page))


def offset_url(url: Column, offset: Column, param: str = "offset") -> Column:
    return page_url(url, offset, param, "{offset}")


def page_urls(pages: DataFrame, max_pages: int = 5, start: int = 1, step: int = 1, param: str = "page") -> DataFrame:
    """pages (page_id, url) to page_id, page_no, page_url; page 0 is the URL itself."""
    each = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("page_no"))
    number = F.lit(start) + F.col("page_no") * step
    return each.select("page_id", "page_no", F.when(F.col("page_no") == 0, F.col("url")).otherwise(page_url(F.col("url"), number, param)).alias("page_url"))


def next_links(nodes: DataFrame, rels: str = "next") -> DataFrame:
    """page_id, href: the first link or anchor of the node relation whose rel holds next."""
    hit = nodes.where(F.col("tag").isin("a", "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), rels) & (F.trim("href") != ""))
    return hit.groupBy("page_id").agg(F.min_by("href", "node_id").alias("href"))


def rel_next(responses: DataFrame) -> DataFrame:
    """feed_id, url: the next page of each response (feed_id, url, body), by rel; feeds that end are left out."""
    found = next_links(shred.shred(responses, "feed_id", "body", ("page_id", "node_id", "tag", "href", "rel"))).withColumnRenamed("page_id", "feed_id")
    both = found.join(responses.select("feed_id", F.col("url").alias("base")), "feed_id")
    return both.select("feed_id", urls.resolve(F.trim("href"), F.col("base")).alias("url")).where("url is not null")


def by_selector(selector: str) -> Callable[[DataFrame], DataFrame]:
    """A next_of for crawl: the target of the first element of a CSS selector, or else of an XPath; its text where it has no href.

    An empty href ends the paging.
    """
    try:
        css.compile_selector(selector)
    except css.SelectorError as e:
        try:
            return by_xpath(selector)
        except xpath.XPathError as x:
            raise css.SelectorError(f"neither CSS ({e}) nor XPath ({x}): {selector!r}") from x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feed, url, body = (c.to_pylist() for c in b.columns)
            found = [css.first(parse(x), selector) if x is not None else None for x in body]
            told = [None if n is None else n.attrs.get("href", n.text()).strip() for n in found]
            yield pa.RecordBatch.from_pydict({"feed_id": feed, "url": [resolved(t, u or "") if t else None for t, u in zip(told, url, strict=True)]}, pa.schema([("feed_id", pa.int64()), ("url", pa.string())]))

    return lambda responses: responses.select("feed_id", "url", "body").mapInArrow(run, "feed_id long, url string").where("url is not null")


def by_xpath(path: str) -> Callable[[DataFrame], DataFrame]:
    """The same by an XPath, over the node relation; it may end in an attribute."""
    xpath.compile_path(path)
    columns = tuple(c for c in xpath.NODES if c != "text" or "." in path or "normalize-space" in path)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feed, body, node = (c.to_pylist() for c in b.columns)
            said = [shred.numbered(parse(x))[i].text() for x, i in zip(body, node, strict=True)]
            yield pa.RecordBatch.from_pydict({"feed_id": feed, "told": said}, pa.schema([("feed_id", pa.int64()), ("told", pa.string())]))

    def next_of(responses: DataFrame) -> DataFrame:
        nodes = written(shred.shred(responses, "feed_id", "body", columns), "nodes")
        found = written(xpath.first(nodes, path).withColumnRenamed("page_id", "feed_id"), "found")
        bare = found.where("href is null and value is null").select("feed_id", "node_id")
        said = responses.join(bare, "feed_id").select("feed_id", "body", "node_id").mapInArrow(texts, "feed_id long, told string")
        told = found.where("href is not null or value is not null").select("feed_id", F.coalesce("value", "href").alias("told")).unionByName(said)
        both = told.where(F.trim("told") != "").join(responses.select("feed_id", F.col("url").alias("base")), "feed_id")
        return both.select("feed_id", urls.resolve(F.trim("told"), F.col("base")).alias("url")).where("url is not null")

    return next_of


def json_cursor(body: Column, path: str) -> Column:
    """A dotted path into a JSON body as text."""
    return F.get_json_object(body, "$." + path)


def follow(requests: DataFrame, store: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests (url) with their stored responses by URL without fragment; null where nothing is stored.

    A store may also be a function of requests (feed_id, url), such as one that fetches them.
    """
    if callable(store):
        store = store(requests.select("feed_id", "url").distinct())
    r = requests.withColumn("_key", urls.without_fragment(F.col("url")))
    s = store.withColumn("_key", urls.without_fragment(F.col("url"))).drop("url")
    return r.join(s, "_key", "left").drop("_key")


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links whose URL was not fetched yet."""
    return links.join(visited.select(F.col("url")).distinct(), "url", "left_anti")


def crawl(store: DataFrame | Callable[[DataFrame], DataFrame], start: DataFrame, next_of: Callable[[DataFrame], DataFrame], max_pages: int = 5) -> DataFrame:
    """start (feed_id, url) and up to max_pages - 1 follow-ups each; next_of(responses) gives feed_id, url.

    feed_id, page_no, url and the stored columns. An unknown or visited URL (fragments aside) ends a feed's paging. Each round is one join
    with the store and is written, so neither its plan nor its work is repeated by the next. Of several responses stored
    for a URL the one of the least body hash counts, of several URLs of a feed the least.
    """
    visited: DataFrame | None = None
    current = start.groupBy("feed_id").agg(F.min("url").alias("url")).withColumn("page_no", F.lit(0))
    for k in range(max_pages):
        one = follow(current, store).where("body is not null").groupBy("feed_id").agg(F.min_by(F.struct("*"), F.xxhash64("body")).alias("_r"))
        got = written(one.select("_r.*"), "round")
        visited = got if visited is None else visited.unionByName(got)
        if k + 1 == max_pages or got.isEmpty():
            break
        nxt = next_of(got).groupBy("feed_id").agg(F.min("url").alias("url")).withColumn("page_no", F.lit(k + 1))
        seen = visited.select("feed_id", urls.without_fragment(F.col("url")).alias("_seen"))
        current = nxt.withColumn("_seen", urls.without_fragment(F.col("url"))).join(seen, ["feed_id", "_seen"], "left_anti").drop("_seen")
    return visited


def first_success(attempts: DataFrame, by: str = "feed_id") -> DataFrame:
    """Of ranked attempts (by, rank, items) the first with items."""
    return attempts.where("items > 0").groupBy(by).agg(F.min_by("strategy", "rank").alias("selected_strategy"), F.min("rank").alias("rank"))
