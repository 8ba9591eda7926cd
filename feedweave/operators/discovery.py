"""What a page says about itself and where else to look: its own address, native feeds, sitemaps and the readers it suits.

Pages are shredded once with the few columns asked for; every rule is a filter or an aggregate over the node relation,
and sitemaps are read from a store of responses in at most three rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import urls
from feedweave.operators import followups
from feedweave.operators.paging import follow
from feedweave.sources.shared import written

#: Columns of the node relation that the rules need.
NODES = ("page_id", "node_id", "tag", "tag_path", "all_attributes")
#: Types of native feeds, and where a page without a link to its sitemap is asked for it.
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
SITEMAP_PATH = "/sitemap.xml"


def _attribute(name: str) -> Column:
    return F.col("all_attributes")[name]


def _says(name: str, value: str) -> Column:
    return F.coalesce(_attribute(name) == value, F.lit(False))


def page_urls(nodes: DataFrame) -> DataFrame:
    """page_id, url: a page's own address by its canonical link, og:url, twitter:url or base, the first that is absolute.

    Of each kind the first element counts, even if it is blank.
    """
    tag = F.col("tag")
    kinds = [((tag == "link") & _says("rel", "canonical"), "href"), ((tag == "meta") & _says("property", "og:url"), "content"), ((tag == "meta") & _says("name", "twitter:url"), "content"), ((tag == "base") & _attribute("href").isNotNull(), "href")]
    kind, value = None, None
    for k, (test, attribute) in enumerate(kinds):
        kind = (F if kind is None else kind).when(test, k)
        value = (F if value is None else value).when(test, _attribute(attribute))
    first = nodes.select("page_id", "node_id", kind.alias("kind"), value.alias("value")).where("kind is not null").groupBy("page_id", "kind").agg(F.min_by("value", "node_id").alias("value"))
    told = first.withColumn("value", F.trim("value")).where(F.regexp_like("value", F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")))
    return told.groupBy("page_id").agg(F.min_by("value", "kind").alias("_u")).select("page_id", urls.normalize_url(F.col("_u")).alias("url"))


def alternate_feeds(nodes: DataFrame) -> DataFrame:
    """page_id, position, href, mime_type of the native feeds that a page's head names, in order."""
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(_attribute("type"), F.lit("")), "^([^;]*)", 1)))
    inside = F.array_contains(F.slice(F.split("tag_path", ">"), 1, F.greatest(F.size(F.split("tag_path", ">")) - 1, F.lit(0))), "head")
    named = F.array_contains(F.split(F.coalesce(_attribute("rel"), F.lit("")), r"\s+"), "alternate")
    href = F.trim(_attribute("href"))
    found = nodes.where((F.col("tag") == "link") & inside & named & (href != "") & kind.isin(*FEED_TYPES))
    return found.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1).alias("position"), href.alias("href"), kind.alias("mime_type"))


def sitemap_targets(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, url: where each page (page_id, url) is asked for a sitemap."""
    link = nodes.where((F.col("tag") == "link") & _says("rel", "sitemap") & _attribute("href").isNotNull())
    first = link.groupBy("page_id").agg(F.min_by(_attribute("href"), F.col("node_id")).alias("_href"))
    both = pages.select("page_id", "url").join(first, "page_id", "left")
    return both.select("page_id", urls.resolve(F.coalesce(F.trim("_href"), F.lit(SITEMAP_PATH)), F.col("url")).alias("url")).where("url is not null")


def sitemap_entries(nodes: DataFrame, pages: DataFrame, store: DataFrame, as_of: str, *, most: int = 3, **limits) -> DataFrame:
    """feed_id, position, url, title, published_at, priority, changefreq of the pages (page_id, url, html).

    A page that is a sitemap with entries gives them; of others the linked sitemap is read, or that of SITEMAP_PATH; an
    index gives the entries of its first `most` sitemaps, in order. What is not stored has none.
    """
    direct = pages.where(F.regexp_like("html", F.lit(r"<(?:[\w-]+:)?(?:urlset|sitemapindex)[\s>]"))).select(F.col("page_id").alias("feed_id"), F.col("html").alias("body"))
    own = written(followups.sitemap(direct, as_of, **limits), "sitemaps")
    open_ = pages.join(own.select(F.col("feed_id").alias("page_id")).distinct(), "page_id", "left_anti")
    asked = sitemap_targets(nodes, open_).withColumnRenamed("page_id", "feed_id")
    got = written(follow(asked, store).where("body is not null").select("feed_id", "body"), "sitemaps")
    index = written(followups.sub_sitemaps(got, most), "sitemaps")
    plain = followups.sitemap(got.join(index.select("feed_id").distinct(), "feed_id", "left_anti"), as_of, **limits)
    # a child sitemap is a feed of its own until its entries are put in line
    child = index.withColumn("_child", F.xxhash64("feed_id", "position", "url"))
    below = written(follow(child, store).where("body is not null").select("_child", F.col("feed_id").alias("_parent"), F.col("position").alias("_at"), "body"), "sitemaps")
    entries = followups.sitemap(below.select(F.col("_child").alias("feed_id"), "body"), as_of, **limits).withColumnRenamed("feed_id", "_child")
    entries = entries.join(below.select("_child", "_parent", "_at"), "_child").withColumn("feed_id", F.col("_parent")).drop("_child", "_parent")
    lined = own.unionByName(plain).withColumn("_at", F.lit(0)).unionByName(entries)
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy("_at", "position")) - 1
    return lined.withColumn("position", place).drop("_at")


def eligible_readers(candidates: DataFrame, order: list[str]) -> DataFrame:
    """feed_id, readers: which readers found something on a page (candidate rows feed_id, scraper), in the given order."""
    found = candidates.where(F.col("scraper").isin(*order)).groupBy("feed_id").agg(F.collect_set("scraper").alias("_s"))
    return found.select("feed_id", F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains("_s", r)).alias("readers"))
