"""Registered queries of the feed engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import dates, destinations, postprocess, texts, urls
from feedweave.functions import lexicon as L
from feedweave.operators import admission, auto, clusters, diagnostics, discovery, domains, feeds, followups, paging, policy, segments, selectors, shred, structured
from feedweave.sources import captures, fetch
from feedweave.sources import responses as stored
from feedweave.sources import shared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with much work each: a table of fewer splits than cores is dealt over them, a larger one is read by its splits."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to be parsed."""
    return dealt(table(spark, sf_dir, "pages"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).select(F.col("page_id").alias("feed_id"), "url", F.col("html").alias("body"), F.lit("text/html").alias("content_type"))


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links of every page by the selector engine: page_id, position, title, href, page_url, url."""
    config = {"selectors": {"items": {"selector": "nav li a", "enhance": False}, "title": {}, "description": {"extractor": "attribute", "attribute": "href"}}}
    got = selectors.query(responses(spark, sf_dir), config)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("feed_id"), F.col("url").alias("page_url"))
    out = got.join(pages, "feed_id").select(F.col("feed_id").alias("page_id"), "position", "title", F.col("description").alias("href"), "page_url")
    return out.withColumn("url", F.concat(F.regexp_extract("page_url", r"^([a-z]+://[^/?#]*)", 1), "href"))


def unent(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


NAV = f"""nav AS (SELECT page_id, url AS page_url, CAST(i - 1 AS INTEGER) AS position, {unent('h[i]')} AS href, {unent('t[i]')} AS title,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {unent('h[i]')} AS url
 FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages), unnest(range(1, len(h) + 1)) AS r(i))"""


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SEGS = "list_filter(string_split(coalesce(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), lambda s: s <> '')"


def _junk(s: str) -> str:
    return f"(list_contains({quoted(L.HIGH_JUNK)}, {s}) OR (regexp_matches({s}, {lit(L.HOST_SHAPED)}) AND NOT regexp_matches({s}, {lit(L.FILE_EXTENSION)})))"


def facts_sql(source: str, columns: str) -> str:
    """CTEs from source (columns, url) to facts."""
    c, ut, v, tx = quoted(L.CONTENT), quoted(L.UTILITY), quoted(L.VANITY), quoted(L.TAXONOMY)
    return f"""
f1 AS (SELECT {columns}, url, {SEGS.format(u='url')} AS p FROM {source}),
f2 AS (SELECT *, len(p) AS n, list_transform(p, lambda s: {_junk('s')}) AS j FROM f1),
f3 AS (SELECT *, n > 0 AND j[1] AS lead, n > 0 AND j[n] AS lastjunk, p[n] AS last_, list_contains(j, true) AS anyj,
  n > 1 AND NOT j[1] AND len(list_filter(p[1:n-1], lambda s: list_contains({c}, s) OR regexp_matches(s, '{L.YEARISH}') OR list_contains({quoted(L.DEEP_POST_CONTEXT)}, s))) > 0 AS trusted,
  NOT list_contains(j, false) AS allj, n > 1 AND NOT list_contains(j[1:n-1], false) AS deep,
  list_has_any(p, {ut}) AS utility_path, list_has_any(p, {v}) AS vanity_path, list_has_any(p, {tx}) AS taxonomy_path,
  n <= 1 OR (n = 2 AND j[n]) AS shallow FROM f2),
f4 AS (SELECT *, n > 0 AND NOT lastjunk AND NOT list_contains({v}, last_) AND (regexp_matches(last_, '{L.YEARISH}') OR regexp_matches(last_, '{L.POST_SLUG}')) AND trusted AS s0 FROM f3),
f5 AS (SELECT *, coalesce(s0, false) AS strong_post_suffix, NOT lead AND (list_has_any(p, {c}) OR (len(list_filter(p, lambda s: regexp_matches(s, '{L.YEARISH}'))) > 0 AND (coalesce(s0, false) OR trusted))) AS content_path FROM f4),
facts AS (SELECT *, NOT (n = 0 OR content_path OR strong_post_suffix) AND (anyj OR taxonomy_path OR allj OR deep OR (shallow AND (anyj OR vanity_path))) AS high_confidence_junk_path,
  NOT (n = 0 OR content_path OR strong_post_suffix) AND (vanity_path OR taxonomy_path OR allj OR deep OR (shallow AND utility_path)) AS high_confidence_utility_destination FROM f5)"""


FACTS = ("content_path", "utility_path", "vanity_path", "taxonomy_path", "shallow", "strong_post_suffix", "high_confidence_junk_path", "high_confidence_utility_destination")
WC = r"CAST(len(regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{Nd}}]+')) AS BIGINT)"
DOMAIN = "array_to_string(list_slice(string_split(lower(regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1)), '.'), -2, -1), '.')"


def sql_case(pairs, x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(p)}) THEN '{r}'" for r, p in pairs) + " END"


@query("flagship_article_feed", f"""SELECT page_id, trim({unent("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""")
def flagship_article_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items = article, title from h1, other fields filled; channel language beside it."""
    pages = responses(spark, sf_dir)
    got = admission.dedup(selectors.query(pages, {"selectors": {"items": {"selector": "article"}, "title": {"selector": "h1"}}}))
    channel = feeds.channels(pages.withColumn("headers", F.create_map().cast("map<string,string>")))
    return got.join(channel.select("feed_id", "language"), "feed_id").select(F.col("feed_id").alias("page_id"), "title", "language")


@query("article_fields")
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.query(responses(spark, sf_dir), {"selectors": {"items": {"selector": "article"}, "title": {"selector": "h1"}}})


@query("channel_rows", f"""SELECT page_id AS feed_id, trim({unent("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title, url, 'Latest items from ' || url AS description, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CAST(360 AS INTEGER) AS ttl FROM pages""")
def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = responses(spark, sf_dir).withColumn("headers", F.create_map().cast("map<string,string>"))
    return feeds.channels(pages).select("feed_id", "title", "url", "description", "language", "ttl")


@query("nav_items", f"WITH {NAV} SELECT page_id, position, title, href, url FROM nav")
def nav_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav(spark, sf_dir).select("page_id", "position", "title", "href", "url")


@query("nav_items_reverse", f"WITH {NAV} SELECT page_id, CAST(count(*) OVER (PARTITION BY page_id) - 1 - position AS INTEGER) AS position, title FROM nav")
def nav_items_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"selectors": {"items": {"selector": "nav li", "order": "reverse", "enhance": False}, "title": {"selector": "a"}}}
    return selectors.query(responses(spark, sf_dir), config).select(F.col("feed_id").alias("page_id"), "position", "title")


@query("node_histogram", """SELECT page_id, count(*) FILTER (x = 'a') AS links, count(*) FILTER (x = 'li') AS items, count(*) FILTER (x = 'article') AS articles, count(*) FILTER (x = 'h1') AS headings
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(a|li|article|h1)[ >]', 1)) AS x FROM pages) GROUP BY page_id""")
def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred.shred(pages_of(spark, sf_dir), columns=("page_id", "tag"))
    return nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(n) for t, n in (("a", "links"), ("li", "items"), ("article", "articles"), ("h1", "headings"))])


@query("link_counts_by_path", f"""WITH {NAV} SELECT page_id, 'html>body>nav>ul>li>a' AS tag_path, count(*) AS links, CAST(1 AS INTEGER) AS rank FROM nav GROUP BY page_id HAVING count(*) >= 2""")
def link_counts_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.link_lists(shred.shred(pages_of(spark, sf_dir)))


@query("semantic_segments", "SELECT page_id, 'article' AS tag, CAST(count(*) AS BIGINT) AS segments FROM (SELECT page_id, unnest(regexp_extract_all(html, '<article>')) FROM pages) GROUP BY page_id")
def semantic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred.shred(pages_of(spark, sf_dir), columns=("page_id", "node_id", "last_desc", "tag", "depth", "chrome", "non_leaf"))
    return segments.semantic(nodes).where("tag = 'article'").groupBy("page_id", "tag").agg(F.count("*").alias("segments"))


@query("cluster_groups")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = clusters.grouped(shared.written(shred.shred(pages_of(spark, sf_dir), columns=clusters.NODES), "nodes"))
    return groups.select("page_id", "signature", "size", "place")


@query("surface_class", """SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<a href=')) >= 20 THEN 'high_entropy_surface' ELSE 'unsupported_surface' END AS surface FROM pages""")
def surface_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of(spark, sf_dir)
    nodes = shred.shred(pages)
    shell = F.col("dom_id").isin("app", "root", "__next") | F.contains(F.coalesce("dom_id", F.lit("")), F.lit("app-shell"))
    per = nodes.groupBy("page_id").agg(F.count_if((F.col("tag") == "a") & F.col("href").isNotNull()).alias("anchors"), F.count_if(F.col("tag") == "article").alias("articles"), F.bool_or(shell).alias("shell"), F.max(F.when(F.col("tag") == "body", F.length("visible_text"))).alias("chars"))
    both = pages.select("page_id", texts.interstitial(F.col("html")).alias("blocked")).join(per, "page_id")
    surface = (
        F.when(F.col("blocked").isNotNull(), "blocked_surface")
        .when(F.col("shell") & (F.col("anchors") <= 2) & (F.col("articles") == 0) & (F.coalesce("chars", F.lit(0)) <= 220), "app_shell")
        .when(F.col("anchors") >= 20, "high_entropy_surface")
        .otherwise("unsupported_surface")
    )
    return both.select("page_id", surface.alias("surface"))


@query("url_parts", r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
 CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[urls.part(F.col("url"), p).alias(p) for p in ("scheme", "host", "path", "query", "fragment")])


@query("url_identity", "SELECT page_id, regexp_replace(url, '#.*$', '') AS identity, NOT contains(url, '@') AS valid_channel FROM pages")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.without_fragment(F.col("url")).alias("identity"), urls.valid_channel(F.col("url")).alias("valid_channel"))


@query("url_path_segments", f"SELECT page_id, array_to_string({SEGS.format(u='url')}, '|') AS segments, CAST(len({SEGS.format(u='url')}) AS INTEGER) AS n FROM pages")
def url_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = urls.path_segments(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(s, "|").alias("segments"), F.size(s).alias("n"))


@query("url_query_values", r"""SELECT page_id, k AS name, max_by(v, i) AS value FROM (SELECT page_id, i, regexp_extract(q[i], '^([^=]*)', 1) AS k, regexp_extract(q[i], '=(.*)$', 1) AS v
 FROM (SELECT page_id, list_filter(string_split(CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) ELSE '' END, '&'), lambda x: x <> '') AS q FROM pages), unnest(range(1, len(q) + 1)) AS r(i)) GROUP BY page_id, k""")
def url_query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.query_values(F.col("url"))).alias("name", "value"))


@query("url_channel_titleized", rf"""SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) || CASE WHEN len(s) > 0 THEN ': ' || array_to_string(list_transform(string_split(array_to_string(s, ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE '' END AS title
FROM (SELECT page_id, url, list_transform({SEGS.format(u='url')}, lambda x: regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')) AS s FROM pages)""")
def url_channel_titleized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.channel_titleized(F.col("url")).alias("title"))


@query("registrable_domain", f"SELECT page_id, {DOMAIN.format(u='url')} AS domain FROM pages")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("destination_facts", f"WITH {NAV}, {facts_sql('nav', 'page_id, position')} SELECT page_id, position, {', '.join(FACTS)} FROM facts")
def destination_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav(spark, sf_dir).withColumn("f", destinations.facts(F.col("url"))).select("page_id", "position", *[F.col(f"f.{c}").alias(c) for c in FACTS])


@query("page_destination_facts", f"WITH {facts_sql('pages', 'page_id')} SELECT page_id, {', '.join(FACTS)} FROM facts")
def page_destination_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("f", destinations.facts(F.col("url"))).select("page_id", *[F.col(f"f.{c}").alias(c) for c in FACTS])


NOISE = f"""taxonomy_path OR (utility_path AND NOT content_path AND NOT strong_post_suffix AND {WC.format(x='title')} <= 3)
 OR (regexp_matches(title, {lit(L.RECOMMENDED_TEXT)}) AND shallow) OR (regexp_matches(title, {lit(L.UTILITY_PREFIX_TEXT)}) AND high_confidence_utility_destination) OR (regexp_matches(title, {lit(L.UTILITY_TEXT)}) AND vanity_path)
 OR (NOT content_path AND regexp_matches(title, {lit(L.UTILITY_TEXT)}) AND NOT strong_post_suffix)"""


@query("noise_anchor", f"WITH {NAV}, {facts_sql('nav', 'page_id, position, title')} SELECT page_id, position, {NOISE} AS noise FROM facts")
def noise_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return nav(spark, sf_dir).withColumn("f", destinations.facts(F.col("url"))).select("page_id", "position", destinations.noise_anchor(F.col("title"), F.col("f"), no, no, no).alias("noise"))


@query("primary_links", f"""WITH {NAV}, {facts_sql('nav', 'page_id, position, title, href')} SELECT page_id, href, CAST(10 * ({WC.format(x='title')} >= 1)::INT + 10 * content_path::INT AS INTEGER) AS points
FROM facts WHERE NOT ({NOISE}) AND ({WC.format(x='title')} >= 1 OR content_path)""")
def primary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every item of the navigation, as main content, its link if that is no noise."""
    pages = open_navigation(spark, sf_dir).select(F.col("feed_id").alias("page_id"), "url", F.col("body").alias("html"))
    nodes = shared.written(shred.shred(pages), "nodes")
    roots = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("root_id"), "last_desc")
    return segments.primary_links(nodes, roots, pages).select("page_id", "href", "points")


@query("list_segments", f"WITH {NAV} SELECT page_id, position, href FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM nav) WHERE n >= 2")
def list_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation, as main content, is a link list; each item stands for its link."""
    pages = open_navigation(spark, sf_dir).select(F.col("feed_id").alias("page_id"), F.col("body").alias("html"))
    nodes = shared.written(shred.shred(pages), "nodes")
    found = segments.list_segments(nodes)
    return found.join(nodes.select("page_id", F.col("node_id").alias("link_id"), "href"), ["page_id", "link_id"]).select("page_id", "position", "href")


def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_extract("text", "^([^\n]*)", 1).alias("title"), "text")


TITLES = "t AS (SELECT doc_id, regexp_extract(text, '^([^\\n]*)', 1) AS title, text FROM documents)"


@query("word_count_docs", f"SELECT doc_id, {WC.format(x='text')} AS words FROM documents")
def word_count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.word_count(F.col("text")).alias("words"))


@query("junk_title_reason", f"WITH {TITLES} SELECT doc_id, {sql_case(L.JUNK_TITLE_RULES, 'title')} AS reason, {WC.format(x='title')} < 3 AS low_word_count FROM t")
def junk_title_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return doc_titles(spark, sf_dir).select("doc_id", texts.junk_title_reason(t).alias("reason"), (texts.word_count(t) < L.MIN_WORDS).alias("low_word_count"))


CLEAN = f"""c AS (SELECT *, regexp_replace(url, '#.*$', '') AS identity, row_number() OVER (PARTITION BY page_id, regexp_replace(url, '#.*$', '') ORDER BY position) AS k FROM nav),
{facts_sql('c', 'page_id, position, title, page_url, identity, k')},
r AS (SELECT page_id, position, CASE WHEN trim(title) = '' THEN 'invalid' WHEN k > 1 THEN 'duplicate_url' WHEN identity = regexp_replace(page_url, '#.*$', '') THEN 'self_link'
 WHEN {DOMAIN.format(u='url')} <> {DOMAIN.format(u='page_url')} THEN 'different_domain'
 WHEN high_confidence_junk_path OR high_confidence_utility_destination OR (utility_path AND NOT content_path AND NOT strong_post_suffix) THEN 'excluded_destination'
 WHEN {sql_case(L.JUNK_TITLE_RULES, 'trim(title)')} IS NOT NULL THEN {sql_case(L.JUNK_TITLE_RULES, 'trim(title)')} WHEN {WC.format(x='title')} < 3 THEN 'low_word_count' END AS reason FROM facts)"""


def nav_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.reasons(nav(spark, sf_dir).withColumns({"id": F.col("href"), "description": F.lit(None).cast("string")}), by="page_id")


@query("cleanup_reasons", f"WITH {NAV}, {CLEAN} SELECT page_id, position, reason FROM r")
def cleanup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_reasons(spark, sf_dir).select("page_id", "position", "reason")


@query("admission_tallies", f"WITH {NAV}, {CLEAN} SELECT page_id, reason, count(*) AS drops FROM r WHERE reason IS NOT NULL GROUP BY page_id, reason")
def admission_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallied = admission.tallies(nav_reasons(spark, sf_dir), "page_id", "reason")
    return tallied.select("page_id", F.explode("tallies").alias("reason", "drops"))


@query("dedup_first", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    rows = c.select(F.col("conv_id").alias("feed_id"), F.col("turn").alias("position"), none.alias("url"), F.col("text").alias("id"), none.alias("guid"), none.alias("title"), none.alias("description"))
    return admission.dedup(rows).select(F.col("feed_id").alias("conv_id"), F.col("position").alias("turn"))


@query("dedup_dropped", "SELECT source AS feed_id, count(*) - count(DISTINCT text) AS dropped FROM documents GROUP BY source")
def dedup_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("feed_id"), F.col("doc_id").alias("position"), none.alias("url"), F.col("text").alias("id"), none.alias("guid"), none.alias("title"), none.alias("description"))
    kept = admission.dedup(rows).groupBy("feed_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("feed_id").agg(F.count("*").alias("n")).join(kept, "feed_id").select("feed_id", (F.col("n") - F.col("kept")).alias("dropped"))


SCORED = f"""{facts_sql('nav', 'page_id, position, title')},
o AS (SELECT page_id, position, url, {WC.format(x='title')} AS w, length(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS pl, content_path AS cp, strong_post_suffix AS sp, utility_path AS up, shallow, high_confidence_junk_path AS jp,
 regexp_matches(title, {lit(L.UTILITY_PREFIX_TEXT)}) AS pre, regexp_matches(title, {lit(L.RECOMMENDED_TEXT)}) AS rec FROM facts),
s AS (SELECT page_id, position, url, CAST(40 * (w >= 3)::INT + 15 * (w >= 7)::INT + 20 * (pl > 6)::INT + 15 * cp::INT AS INTEGER) AS quality,
 CAST(25 * (up AND NOT cp AND NOT sp)::INT + 15 * (pre AND w <= 6)::INT + 10 * shallow::INT + 10 + 10 * (rec AND NOT cp)::INT + 5 * jp::INT AS INTEGER) AS junk FROM o)"""


def scored_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nav(spark, sf_dir).withColumn("f", destinations.facts(F.col("url")))
    no = F.lit(False)
    n = n.withColumn("o", segments.observation(F.col("title"), F.col("f"), urls.part(F.col("url"), "path"), no, no, no, F.lit("")))
    quality, junk = segments.score(F.col("o"))
    return n.withColumns({"quality": quality, "junk": junk}).withColumn("score", F.col("quality") - F.col("junk"))


@query("segment_scores", f"WITH {NAV}, {SCORED} SELECT page_id, position, quality, junk FROM s")
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_nav(spark, sf_dir).select("page_id", "position", "quality", "junk")


@query("score_rank", f"WITH {NAV}, {SCORED} SELECT page_id, position, CAST(row_number() OVER (PARTITION BY page_id ORDER BY quality - junk DESC, position) AS INTEGER) AS rank FROM s WHERE quality - junk >= 0")
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.rank_top(scored_nav(spark, sf_dir)).select("page_id", "position", "rank")


@query("best_per_destination", f"WITH {NAV}, {SCORED} SELECT page_id, url, position FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY quality - junk DESC, quality DESC, position) AS k FROM s) WHERE k = 1")
def best_per_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.first_per(scored_nav(spark, sf_dir), ["page_id", "url"], [F.desc("score"), F.desc("quality"), F.col("position")]).select("page_id", "url", "position")


@query("topk_per_group", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.first_per(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query("tier_short_circuit", """WITH c AS (SELECT user_id, event_id, event_id % 4 + 1 AS tier, value > 50 AS admitted FROM events),
p AS (SELECT user_id, tier, count(*) AS raw, count(*) FILTER (admitted) AS adm FROM c GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(raw) OVER w, 0) AS rb, coalesce(sum(adm) OVER w, 0) AS ab FROM p WINDOW w AS (PARTITION BY user_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c.user_id, c.event_id, c.tier FROM c JOIN b ON c.user_id = b.user_id AND c.tier = b.tier WHERE NOT (rb >= 3 AND ab >= 3) AND NOT (c.tier = 4 AND ab > 0)""")
def tier_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4 + 1).alias("tier"), (F.col("value") > 50).alias("admitted"))
    return admission.run_tiers(c, limit=3, last_tier=4, by="user_id").select("user_id", "event_id", "tier")


@query("status_tallies", "SELECT user_id AS feed_id, string_agg(event_type || ' (' || n || ')', ', ' ORDER BY event_type) AS tallies FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def status_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("feed_id"), F.col("event_type").alias("scraper"))
    return feeds.status(rows).select("feed_id", F.regexp_extract("generator", r"scrapers: (.*)\)$", 1).alias("tallies"))


@query("gsub_part", "SELECT p_partkey, regexp_replace(p_name, '(?i)[aeiou]+', '*', 'g') AS name FROM part")
def gsub_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", postprocess.gsub_column(F.col("p_name"), "/ [aeiou]+ /", "*").alias("name"))


@query("substring_part", "SELECT p_partkey, substr(p_name, 3, 5) AS middle, substr(p_name, length(p_name) - 3, 3) AS tail FROM part WHERE length(p_name) >= 8")
def substring_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.length("p_name") >= 8)
    return p.select("p_partkey", postprocess.substring_column(F.col("p_name"), 2, 6).alias("middle"), postprocess.substring_column(F.col("p_name"), -4, -2).alias("tail"))


@query("template_part", "SELECT p_partkey, p_brand || ' - ' || p_type || ' (' || CAST(p_size AS VARCHAR) || ')' AS label FROM part")
def template_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: F.col(f"p_{c}") for c in ("brand", "type", "size")}
    return table(spark, sf_dir, "part").select("p_partkey", postprocess.template_column("%{brand} - %<type>s (%{size})", fields).alias("label"))


@query("parse_time_rfc822", "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM events")
def parse_time_rfc822(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in five ways are read and written as mail time."""
    ways = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss '+0000'", "d.M.yyyy, h:mm:ss a", "EEEE, d. MMM yyyy 'at' HH:mm:ss")
    kind, text = F.col("event_id") % len(ways), None
    for k, way in enumerate(ways):
        text = (F if text is None else text).when(kind == k, F.date_format("ts", way))
    return dealt(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", postprocess.parse_time_column(text).alias("published"))


@query("zoned_dates", """WITH t AS (SELECT event_id, event_id % 240 AS m, CASE event_id % 3 WHEN 0 THEN '2024-10-27' WHEN 1 THEN '2024-03-31' ELSE '2024-07-01' END AS day FROM events),
o AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN -5 WHEN day = '2024-07-01' THEN 2 WHEN day = '2024-10-27' THEN CASE WHEN m < 120 THEN 2 ELSE 1 END WHEN m < 120 THEN 1 WHEN m < 180 THEN 0 ELSE 2 END AS h FROM t)
SELECT event_id, strftime(CAST(day AS TIMESTAMP) + to_minutes(CAST(m AS INTEGER)), '%Y-%m-%dT%H:%M:00') || CASE WHEN h < 0 THEN '-0' ELSE '+0' END || abs(h) || ':00' AS published,
 strftime(CAST(day AS TIMESTAMP) + to_minutes(CAST(m AS INTEGER)) - to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M') AS utc FROM o""")
def zoned_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times around both clock changes and in summer, some with an offset of their own, read for Berlin."""
    day = F.get(F.array(*map(F.lit, ("2024-10-27", "2024-03-31", "2024-07-01"))), (F.col("event_id") % 3).cast("int"))
    text = F.format_string("%s %02d:%02d%s", day, F.floor(F.col("event_id") % 240 / 60), F.col("event_id") % 60, F.when(F.col("event_id") % 7 == 0, "-05:00").otherwise(""))
    m = dates.moment(text, "Europe/Berlin")
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", dates.iso(F.col("m")).alias("published"), F.date_format("m.instant", "yyyy-MM-dd HH:mm").alias("utc"))


@query("json_pick", "SELECT event_id, props ->> '$.page' AS page, props ->> '$.ref' AS ref FROM events")
def json_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", paging.json_cursor(F.col("props"), "page").alias("page"), paging.json_cursor(F.col("props"), "ref").alias("ref"))


_DATE = " OR ".join(f"regexp_matches(x, {lit(p)})" for p in L.DATE_SHAPES)


@query("description_rules", rf"""WITH {TITLES}, l AS (SELECT doc_id, title, list_transform(string_split_regex(text, '\n+'), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))) AS x FROM t)
SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, chr(10)) END AS description FROM (SELECT doc_id, list_filter(x, lambda x: x <> '' AND NOT list_contains({quoted([*L.CTA, *L.TYPE_CHIPS, *L.SECTION_NAMES])}, lower(x)) AND NOT suffix(x, ':') AND NOT ({_DATE}) AND NOT (lower(trim(title)) <> '' AND lower(x) = lower(trim(title)))) AS k FROM l)""")
def description_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_titles(spark, sf_dir).select("doc_id", texts.description(F.col("text"), F.col("title")).alias("description"))


@query("strip_title_echo", f"WITH {TITLES} SELECT doc_id, CASE WHEN instr(text, title) > 0 AND instr(text, title) - 1 <= floor(length(text) * 0.5) THEN substr(text, 1, instr(text, title) - 1) || substr(text, instr(text, title) + length(title)) ELSE text END AS rest FROM t")
def strip_title_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_titles(spark, sf_dir).select("doc_id", texts.strip_title_echo(F.col("text"), F.col("title")).alias("rest"))


@query("follow_up_join", f"WITH {NAV} SELECT n.page_id, n.position, p.page_id IS NOT NULL AS stored FROM nav n LEFT JOIN (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS k, min(page_id) AS page_id FROM pages GROUP BY 1) p ON regexp_replace(n.url, '#.*$', '') = p.k")
def follow_up_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "pages").groupBy(urls.without_fragment(F.col("url")).alias("url")).agg(F.min("page_id").alias("stored_id"))
    got = paging.follow(nav(spark, sf_dir).select("page_id", "position", "url"), store)
    return got.select("page_id", "position", F.col("stored_id").isNotNull().alias("stored"))


@query("visited_anti_join", f"WITH {NAV} SELECT page_id, position, url FROM nav WHERE url NOT IN (SELECT url FROM pages)")
def visited_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.unvisited(nav(spark, sf_dir).select("page_id", "position", "url"), table(spark, sf_dir, "pages"))


@query("pagination_urls", r"""SELECT page_id, CAST(k AS INTEGER) AS page_no, CASE WHEN k = 0 THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_concat(list_filter(string_split(CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) ELSE '' END, '&'), lambda x: x <> '' AND regexp_extract(x, '^([^=]*)', 1) <> 'page'), ['page=' || CAST(k + 1 AS VARCHAR)]), '&') || CASE WHEN contains(url, '#') THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END END AS page_url FROM pages, unnest(range(0, 5)) AS r(k)""")
def pagination_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_urls(table(spark, sf_dir, "pages"))


@query("shared_tokens", "WITH w AS (SELECT p_brand, p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS token FROM part) SELECT w.p_brand, w.token FROM w JOIN (SELECT p_brand, count(*) AS parts FROM part GROUP BY 1) t ON w.p_brand = t.p_brand GROUP BY w.p_brand, w.token, t.parts HAVING count(*) = t.parts")
def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that all parts of a brand share, by counting (no list of sets per group)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.explode(F.array_distinct(F.split("p_type", " "))).alias("token"))
    total = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    return p.groupBy("p_brand", "token").agg(F.count("*").alias("n")).join(total, "p_brand").where("n = parts").select("p_brand", "token")


@query("common_prefix", f"SELECT host, CAST(count(*) AS BIGINT) AS pages, min(s[1]) AS first_min, max(s[1]) AS first_max FROM (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, {SEGS.format(u='url')} AS s FROM pages) GROUP BY host")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path prefixes per host: a shared first segment shows as equal bounds."""
    p = table(spark, sf_dir, "pages").select(urls.part(F.col("url"), "host").alias("host"), F.get(urls.path_segments(F.col("url")), F.lit(0)).alias("s"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.min("s").alias("first_min"), F.max("s").alias("first_max"))


@query("interstitial_hits", "SELECT page_id, CASE " + " ".join("WHEN " + " + ".join(f"regexp_matches(html, {lit(p)})::INT" for p in ps) + f" >= {n} THEN '{k}'" for k, n, ps in L.INTERSTITIALS) + " END AS blocked FROM pages")
def interstitial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.interstitial(F.col("html")).alias("blocked"))


@query("fallback_first_success", """SELECT o_custkey AS feed_id, min_by(o_orderpriority, o_orderkey) AS selected_strategy, min(o_orderkey) AS rank FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey""")
def fallback_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feed_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("rank"), (F.col("o_totalprice") > 200000).cast("int").alias("items"))
    return paging.first_success(o)


@query("json_feed_items", f"WITH {NAV} SELECT page_id AS feed_id, position, url AS item_url, title AS item_title FROM nav")
def json_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"selectors": {"items": {"selector": "nav li", "enhance": False}, "title": {"selector": "a"}, "url": {"selector": "a", "extractor": "href"}}}
    got = feeds.json_items(selectors.query(responses(spark, sf_dir), config))
    raw = nav(spark, sf_dir).select(F.col("page_id").alias("feed_id"), "position", F.col("url").alias("item_url"))
    return got.join(raw, ["feed_id", "position"]).select("feed_id", "position", "item_url", F.col("item.title").alias("item_title"))


@query("json_feed")
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = responses(spark, sf_dir)
    got = selectors.query(pages, {"selectors": {"items": {"selector": "article"}, "title": {"selector": "h1"}}})
    return feeds.json_feed(got, feeds.channels(pages.withColumn("headers", F.create_map().cast("map<string,string>"))))


@query("rss_feed")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = responses(spark, sf_dir)
    got = selectors.query(pages, {"selectors": {"items": {"selector": "nav li"}, "title": {"selector": "a"}}})
    return feeds.rss(got, feeds.channels(pages.withColumn("headers", F.create_map().cast("map<string,string>"))))



def bodies(df: DataFrame, key: str, markup: str, *args: str) -> DataFrame:
    """A response per row, its body by a format string over columns."""
    return dealt(df.select(*dict.fromkeys([key, *args]))).select(F.col(key).cast("long").alias("feed_id"), F.lit("https://shop.example/list").alias("url"), F.format_string(markup, *args).alias("body"))


_LD = (
    '<html><head><script type="application/ld+json">{"@context": "https://schema.org", "@type": "CollectionPage", "mainEntity": {"@type": "ItemList", "itemListElement": ['
    '{"@type": "ListItem", "item": {"@type": "Thing", "name": "Item %1$d", "url": "/i/%1$d"}}, {"@type": ["WebPage", "https://schema.org/NewsArticle"], "headline": " ", "name": "Order %1$d", '
    '"@id": "https://shop.example/o/%1$d", "url": "/o/%1$d?x=1", "datePublished": "%2$s", "author": [{"name": "%3$s"}, "desk"], "keywords": "%4$s; order|%3$s", "description": "ab", "articleBody": "abc %3$s"}, '
    '{"@type": "Organization", "name": "none"}]}}</script></head><body></body></html>'
)


@query("schema_articles", """SELECT o_orderkey AS feed_id, 0 AS position, '/i/' || o_orderkey AS id, 'Item ' || o_orderkey AS title, NULL AS description, 'https://shop.example/i/' || o_orderkey AS url, NULL AS author, NULL AS published, '' AS categories FROM orders
UNION ALL SELECT o_orderkey, 1, '/o/' || o_orderkey, 'Order ' || o_orderkey, 'abc ' || o_orderstatus, 'https://shop.example/o/' || o_orderkey || '?x=1', o_orderstatus || ', desk', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority || ',order,' || o_orderstatus FROM orders""")
def schema_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    got = structured.scrape(bodies(o, "o_orderkey", _LD, "o_orderkey", "day", "o_orderstatus", "o_orderpriority"), ("schema",))
    return got.select("feed_id", "position", "id", "title", "description", "url", "author", F.col("published_at_raw").alias("published"), F.array_join("categories", ",").alias("categories"))


@query("microdata_products", "SELECT p_partkey AS feed_id, p_name AS title, 'https://shop.example/p/' || p_partkey AS url, 'https://shop.example/p/' || p_partkey || '.png' AS image, p_brand || ',' || p_type AS categories FROM part")
def microdata_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = (
        '<div itemscope itemtype="https://schema.org/Product"><h2 itemprop="name">%2$s</h2><a itemprop="url" href="/p/%1$d">more</a><img itemprop="image" src="/p/%1$d.png">'
        '<meta itemprop="articleSection" content="%3$s"><meta itemprop="keywords" content="%4$s"><div itemprop="review" itemscope itemtype="https://schema.org/Review"><b itemprop="name">no</b></div></div>'
    )
    got = structured.scrape(bodies(table(spark, sf_dir, "part"), "p_partkey", markup, "p_partkey", "p_name", "p_type", "p_brand"), ("microdata",))
    return got.select("feed_id", "title", "url", "image", F.array_join("categories", ",").alias("categories"))


@query("microformats_entries", "SELECT p_partkey AS feed_id, p_name AS title, 'https://shop.example/e/' || p_partkey AS url, '<b>' || p_type || '</b>' AS description, p_brand AS author, '2024-01-02' AS published FROM part")
def microformats_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = '<div class="h-entry x"><h1 class="p-name"> %2$s </h1><a class="u-url" href="/e/%1$d">l</a><div class="e-content"><b>%3$s</b></div><i class="p-author">%4$s</i><time class="dt-published" datetime="2024-01-02">x</time></div><div class="h-entry"></div>'
    got = structured.scrape(bodies(table(spark, sf_dir, "part"), "p_partkey", markup, "p_partkey", "p_name", "p_type", "p_brand"), ("microformats2",))
    return got.select("feed_id", "title", "url", "description", "author", F.col("published_at_raw").alias("published"))


@query("json_state_articles", """SELECT event_id AS feed_id, 0 AS position, 's' || event_id AS id, event_type AS title, 'https://shop.example/s/' || event_id AS url, 'json_state' AS scraper FROM events
UNION ALL SELECT event_id, 1, 'https://shop.example/w/' || event_id, 'W ' || user_id, 'https://shop.example/w/' || event_id, 'json_state' FROM events""")
def json_state_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = (
        '<script type="application/json">{"a": {"b": [{"attributes": {"title": "%2$s"}, "id": "s%1$d", "link": "/s/%1$d"}, {"x": 1}]}}</script>'
        '<script>var q = 1; window.__NUXT__ = {list: [{headline: "W %3$d", "path": "/w/%1$d", tags: ["}"],},],}; f();</script>'
    )
    got = structured.scrape(bodies(table(spark, sf_dir, "events"), "event_id", markup, "event_id", "event_type", "user_id"), ("json_state",))
    # the two scripts count on in one page
    return got.select("feed_id", "position", "id", "title", "url", "scraper")


@query("captured_articles", "SELECT event_id AS feed_id, event_type AS title, 'https://shop.example/x/' || event_id AS url, props ->> '$.page' AS description FROM events")
def captured_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("page", F.get_json_object("props", "$.page"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("name"), F.concat(F.lit("/x/"), "event_id").alias("href"), F.col("page").alias("summary"))).alias("rows")))
    return structured.captured(e.select(F.col("event_id").alias("feed_id"), F.lit("https://shop.example/list").alias("url"), body.alias("body"))).select("feed_id", "title", "url", "description")


@query("meta_articles", "SELECT p_partkey AS feed_id, CASE WHEN p_partkey % 2 = 0 THEN 'Embed ' || p_brand ELSE p_name END AS title, 'https://shop.example/m/' || p_partkey AS url, p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE p_brand END AS author FROM part")
def meta_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    markup = '<head><meta property="og:title" content="%2$s"><meta name="twitter:title" content="later"><meta property="og:url" content="/m/%1$d"><meta name="twitter:description" content="%3$s"><meta property="article:author" content="%4$s"></head>'
    got = structured.scrape(bodies(part, "p_partkey", markup, "p_partkey", "p_name", "p_type", "p_brand"), ("meta_oembed",))
    stored = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("feed_id"), F.to_json(F.struct(F.concat(F.lit("Embed "), "p_brand").alias("title"), F.lit("E").alias("author_name"), F.lit("<b>x</b>").alias("html"))).alias("body"))
    return followups.oembed(got.select("feed_id", "title", "url", "description", "author", "image"), stored).select("feed_id", "title", "url", "description", "author")


@query("posts_articles", "SELECT o_orderkey AS feed_id, 0 AS position, '/p/' || o_orderkey AS id, 'A & ' || o_orderstatus AS title, 'https://shop.example/p/' || o_orderkey AS url, o_orderpriority AS description, '7,8' AS categories FROM orders UNION ALL SELECT o_orderkey, 2, '/?p=' || o_orderkey, NULL, 'https://shop.example/?p=' || o_orderkey, '<p>x</p>', '' FROM orders")
def posts_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = '[{"title": {"rendered": "A &amp; <i>%2$s</i>"}, "link": "/p/%1$d", "content": {"rendered": " "}, "excerpt": {"rendered": "%3$s"}, "categories": [7, 8]}, {"title": {"rendered": "no link"}}, {"link": "/?p=%1$d", "content": {"rendered": "<p>x</p>"}}]'
    got = followups.posts(bodies(table(spark, sf_dir, "orders"), "o_orderkey", markup, "o_orderkey", "o_orderstatus", "o_orderpriority"))
    return got.select("feed_id", "position", "id", "title", "url", "description", F.array_join("categories", ",").alias("categories"))


@query("sitemap_entries", """SELECT o_orderkey AS feed_id, 'https://shop.example/?a=1&b=' || o_orderkey AS url, o_orderstatus AS title, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 10 AS priority, o_orderdate AS published_at FROM orders WHERE substr(o_orderpriority, 1, 1) >= '3' AND o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY
UNION ALL SELECT o_orderkey, 'https://shop.example/u/' || o_orderkey, NULL, 0.5, NULL FROM orders""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "rank": F.substring("o_orderpriority", 1, 1)})
    markup = (
        "<urlset><url><loc>https://shop.example/?a=1&amp;b=%1$d</loc><lastmod>1990-01-01</lastmod><priority>0.%3$s</priority><news:news><news:publication_date>%2$s</news:publication_date><news:title>%4$s</news:title></news:news></url>"
        "<url><loc> https://shop.example/u/%1$d </loc></url><url><loc>https://shop.example/n</loc><changefreq>Never</changefreq></url></urlset>"
    )
    got = followups.sitemap(bodies(o, "o_orderkey", markup, "o_orderkey", "day", "rank", "o_orderstatus"), "1998-08-01")
    return got.select("feed_id", "url", "title", "priority", "published_at")


_DAY = "date_trunc('day', o_orderdate)"


@query("archive_ranges", f"""SELECT o_orderkey, 'archive' AS reason, strftime({_DAY}, '%Y-%m-%dT00:00:00Z') AS after, strftime({_DAY} + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') AS before, CAST(o_custkey + 1 AS VARCHAR) AS page, NULL AS category FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'archive', NULL, NULL, NULL, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 1""")
def archive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    url = F.when(even, F.concat(F.lit("https://x.example/blog/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/page/"), (F.col("o_custkey") + 1).cast("string"))).otherwise("https://x.example/category/a")
    scope = followups.archive_scope(F.when(even, "date").otherwise(F.concat(F.lit("archive category category-"), "o_custkey")), url)
    q = F.col("scope.query")
    return o.select("o_orderkey", F.explode(F.array(scope)).alias("scope")).select("o_orderkey", F.col("scope.reason").alias("reason"), *[q[k].alias(a) for k, a in (("after", "after"), ("before", "before"), ("page", "page"), ("categories", "category"))])


@query("posts_endpoints", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.example/wp-json/wp/v2/posts?page=' || p_size ELSE 'https://x.example/?rest_route=%2Fwp%2Fv2%2Fposts&lang=en&page=' || p_size END AS url FROM part")
def posts_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("p_partkey") % 2 == 0, "https://x.example/wp-json/").otherwise("https://x.example/?rest_route=/&lang=en")
    return table(spark, sf_dir, "part").select("p_partkey", followups.posts_url(root, F.create_map(F.lit("page"), F.col("p_size").cast("string"))).alias("url"))


BLOCKED = "CASE " + " ".join("WHEN " + " + ".join(f"regexp_matches(html, {lit(p)})::INT" for p in ps) + f" >= {n} THEN '{k}'" for k, n, ps in L.INTERSTITIALS) + " END"


@query("stored_responses", f"SELECT page_id, CASE WHEN {BLOCKED} IS NULL THEN md5(html) END AS digest, CASE WHEN {BLOCKED} IS NOT NULL THEN 'blocked_surface' END AS error FROM pages")
def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw bytes through decompression, charset, kind and guard."""
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("feed_id"), "url", F.lit(200).alias("status"), headers.alias("headers"), F.encode("html", "UTF-8").alias("payload"))
    return stored.responses(raw).select(F.col("feed_id").alias("page_id"), F.md5("body").alias("digest"), "error")


@query("follow_up_policy", r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*?:([0-9]+)', 1) AS port FROM pages)
SELECT page_id, CASE WHEN scheme = 'http' THEN 'unsupported_url_scheme' WHEN host <> 'example.com' OR port NOT IN ('', '443') THEN 'cross_origin_follow_up' END AS denial FROM u""")
def follow_up_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a feed of https://example.com/ may follow."""
    return table(spark, sf_dir, "pages").select("page_id", policy.denial(F.col("url"), F.lit("https://example.com/"), F.lit("follow_up")).alias("denial"))


@query("private_targets", "SELECT user_id, event_id, (a = 10 OR a = 127 OR a = 0 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a BETWEEN 224 AND 239) AS denied FROM (SELECT *, user_id % 256 AS a, event_id % 256 AS b FROM events)")
def private_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal addresses made of event numbers."""
    url = F.format_string("http://%d.%d.1.1/", F.col("user_id") % 256, F.col("event_id") % 256)
    return table(spark, sf_dir, "events").select("user_id", "event_id", policy.private_target(url).alias("denied"))


def open_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose navigation is main content, so that its links are candidates."""
    body = F.regexp_replace("body", r"<(/?)nav\b", "<$1main")
    return responses(spark, sf_dir).select("feed_id", "url", body.alias("body"))


@query("auto_feed")
def auto_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers, admission and limit on every page; link texts are made long enough to be titles."""
    pages = open_navigation(spark, sf_dir).withColumn("body", F.regexp_replace("body", r"(<li><a href=[^>]*>)", "$1A story about "))
    return auto.auto_source(pages)


@query("captured_selectors")
def captured_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item selectors that lead to the navigation links of every page."""
    articles = nav(spark, sf_dir).select(F.col("page_id").alias("feed_id"), "url")
    return auto.capture(open_navigation(spark, sf_dir), articles)


@query("listed_links", """SELECT p_partkey AS page_id, CAST(position AS INTEGER) AS position, 'section' AS tag, '/' || way || '/' || p_partkey AS href
FROM part, (VALUES (0, 'a'), (1, 'b')) AS w(position, way)""")
def listed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cards that share a link path, beside navigation of three: each link climbs to its card."""
    markup = '<html><body><nav><a href="/x">x</a><a href="/y">y</a><a href="/z">z</a></nav><main><section><p><a href="/a/%1$d">One</a></p><i>%2$s</i></section><section><p><a href="/b/%1$d">Two</a></p></section></main></body></html>'
    pages = bodies(table(spark, sf_dir, "part"), "p_partkey", markup, "p_partkey", "p_name").select(F.col("feed_id").alias("page_id"), F.col("body").alias("html"))
    nodes = shared.written(shred.shred(pages, columns=segments.LISTED), "nodes")
    found = segments.list_segments(nodes)
    roots, links = nodes.select("page_id", F.col("node_id").alias("root_id"), "tag"), nodes.select("page_id", F.col("node_id").alias("link_id"), "href")
    return found.join(shared.by_merge(roots), ["page_id", "root_id"]).join(shared.by_merge(links), ["page_id", "link_id"]).select("page_id", "position", "tag", "href")


@query("large_page_nodes", """WITH n AS (SELECT n_nationkey AS page_id, 4990 + n_nationkey AS k FROM nation), s AS (SELECT page_id, k, least(k, 4998) AS i FROM n)
SELECT page_id, CAST(i AS BIGINT) AS italics, CAST(5 AS BIGINT) AS paragraphs, CAST(len(list_filter(range(1, 6), lambda j: 2 + i + 2 * j - 1 < 5000)) AS BIGINT) AS bolds, 2 + k + 10 > 5000 AS degraded FROM s""")
def large_page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about as large as the node limit: beyond it only structural elements stay."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("<html><body>"), F.repeat(F.lit("<i>x</i>"), (4990 + F.col("n_nationkey")).cast("int")), F.repeat(F.lit("<p>y</p><b>z</b>"), F.lit(5)), F.lit("</body></html>")).alias("html"))
    nodes = shred.shred(n, columns=("page_id", "tag", "degraded"))
    return nodes.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(name) for t, name in (("i", "italics"), ("p", "paragraphs"), ("b", "bolds"))], F.bool_or("degraded").alias("degraded"))


@query("deep_page_nodes", "SELECT n_nationkey AS page_id, CAST(1001 + 200 * n_nationkey AS INTEGER) AS deepest, CAST(2 AS INTEGER) AS body_words FROM nation")
def deep_page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements nested thousands deep, read without recursion."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("<html><body>"), F.repeat(F.lit("<div>"), (1000 + 200 * F.col("n_nationkey")).cast("int")), F.lit("two words")).alias("html"))
    nodes = shred.shred(n, columns=("page_id", "tag", "depth", "words"))
    return nodes.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.max(F.when(F.col("tag") == "body", F.col("words"))).alias("body_words"))


@query("rel_next_links", "SELECT p_partkey AS feed_id, 'https://shop.example/n/' || p_partkey AS url FROM part")
def rel_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = '<head><link rel="Prev" href="/x"><link rel="Next nofollow" href=" /n/%1$d "></head><body><a rel="next" href="/later">%2$s</a></body>'
    return paging.rel_next(bodies(table(spark, sf_dir, "part"), "p_partkey", markup, "p_partkey", "p_name"))


_CHAIN = """WITH store AS (SELECT p_partkey AS k, 'https://shop.example/p/' || p_partkey AS url, p_partkey + CASE WHEN p_size <= 40 THEN 1 ELSE 0 END AS follow FROM part)
SELECT k AS feed_id, 0 AS page_no, url FROM store
UNION ALL SELECT a.k, 1, b.url FROM store a JOIN store b ON b.k = a.follow AND b.k <> a.k
UNION ALL SELECT a.k, 2, c.url FROM store a JOIN store b ON b.k = a.follow AND b.k <> a.k JOIN store c ON c.k = b.follow AND c.k <> b.k"""


def _chain(spark: SparkSession, sf_dir: str, markup: str) -> tuple[DataFrame, DataFrame]:
    """A stored page per part that leads to the next part, or to itself where the part is large; and feeds that start at each."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("feed_id"), (F.col("p_partkey") + (F.col("p_size") <= 40).cast("int")).alias("follow"))
    at = F.concat(F.lit("https://shop.example/p/"), F.col("feed_id").cast("string"))
    store = p.select(at.alias("url"), F.format_string(markup, "follow").alias("body"))
    return store, p.select("feed_id", at.alias("url"))


@query("crawled_rel_next", _CHAIN)
def crawled_rel_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three pages of each feed: a visited or unknown page ends it."""
    store, start = _chain(spark, sf_dir, '<body><a href="/q">no</a><a rel="next" href="/p/%1$d#top">on</a></body>')
    return paging.crawl(store, start, paging.rel_next, 3).select("feed_id", "page_no", urls.without_fragment(F.col("url")).alias("url"))


@query("crawled_selector", _CHAIN)
def crawled_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a selector whose element holds the address as text."""
    store, start = _chain(spark, sf_dir, '<body><b class="more"> /p/%1$d </b><b class="more">/q</b></body>')
    return paging.crawl(store, start, paging.by_selector("b.more"), 3).select("feed_id", "page_no", "url")


@query("crawled_xpath", _CHAIN)
def crawled_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an XPath to the link after the current page's, in a store that holds every page twice."""
    store, start = _chain(spark, sf_dir, '<body><ul><li><a href="/q">1</a></li><li class="now">2</li><li><a href="/p/%1$d">3</a></li><li><a href="/q">4</a></li></ul></body>')
    twice = store.unionByName(store.withColumn("body", F.concat("body", F.lit("<!-- again -->"))))
    return paging.crawl(twice, start, paging.by_selector("//li[contains(@class, 'now')]/following-sibling::li[1]/a/@href"), 3).select("feed_id", "page_no", "url")


@query("offset_urls", """SELECT p_partkey AS page_id, CAST(n AS INTEGER) AS page_no, CASE WHEN p_size > 25 THEN 'https://shop.example/l/' || CAST(n * 20 AS VARCHAR) ELSE 'https://shop.example/l?k=' || p_partkey || '&offset=' || CAST(n * 20 AS VARCHAR) END AS url FROM part, range(1, 4) AS r(n)""")
def offset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_size") > 25, "https://shop.example/l/{offset}").otherwise(F.concat(F.lit("https://shop.example/l?k="), F.col("p_partkey").cast("string"))).alias("base"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"))
    return p.select("page_id", "page_no", paging.offset_url(F.col("base"), F.col("page_no") * 20).alias("url"))


_KINDS = ("image/png", "video/mp4", "audio/mpeg", "application/pdf", "text/plain")
_ATTRS = 'loading="lazy" referrerpolicy="no-referrer" decoding="async" crossorigin="anonymous"'


@query("item_descriptions", f"""WITH a AS (SELECT p_partkey, p_name, p_type, p_size % 7 AS kind, CASE WHEN p_size > 25 THEN p_name || ' is ' || p_type || ', of ' || p_brand ELSE p_type || ', of ' || p_brand || ', is ' || p_name END AS said FROM part),
m AS (SELECT *, CASE kind WHEN 0 THEN '<img src="https://shop.example/m?a=1&amp;b=' || p_partkey || '" alt="' || p_name || '" title="' || p_name || '" {_ATTRS}>'
 WHEN 1 THEN '<video controls preload="none" referrerpolicy="no-referrer" crossorigin="anonymous" playsinline><source src="https://shop.example/m?a=1&amp;b=' || p_partkey || '" type="video/mp4"></video>'
 WHEN 2 THEN '<audio controls preload="none" referrerpolicy="no-referrer" crossorigin="anonymous"><source src="https://shop.example/m?a=1&amp;b=' || p_partkey || '" type="audio/mpeg"></audio>'
 WHEN 3 THEN '<iframe src="https://shop.example/m?a=1&amp;b=' || p_partkey || '" width="100%" height="75vh" sandbox="" referrerpolicy="no-referrer" loading="lazy"></iframe>'
 WHEN 4 THEN '<img src="https://shop.example/i.png" alt="' || p_name || '" title="' || p_name || '" {_ATTRS}>' WHEN 5 THEN '<img src="https://shop.example/i.png" alt="' || p_name || '" title="' || p_name || '" {_ATTRS}>' END AS media,
 instr(said, p_name) - 1 AS place FROM a)
SELECT p_partkey AS feed_id, concat_ws(chr(10) || chr(10), media, trim(CASE WHEN place <= floor(length(said) / 2) THEN said[1:place] || said[place + length(p_name) + 1:] ELSE said END)) AS description FROM m""")
def item_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media before the text, else the image; a title in the first half of the text goes. Kind 4 has an enclosure without a rendering, kind 6 nothing."""
    kind = F.col("p_size") % 7
    link = F.concat(F.lit("https://shop.example/m?a=1&b="), F.col("p_partkey").cast("string"))
    enclosure = F.struct(link.alias("url"), F.get(F.array(*map(F.lit, _KINDS)), kind).alias("type"), F.lit(0).cast("long").alias("bytes_length"))
    short = F.concat_ws(", ", "p_type", F.concat(F.lit("of "), F.col("p_brand")))
    said = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" is "), short)).otherwise(F.concat(short, F.lit(", is "), F.col("p_name")))
    articles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("feed_id"), F.col("p_name").alias("title"), said.alias("description"), F.lit("https://shop.example/").alias("url"),
        F.when(kind < 6, "https://shop.example/i.png").alias("image"), F.when(kind < 5, F.array(enclosure)).otherwise(F.array().cast("array<struct<url:string,type:string,bytes_length:bigint>>")).alias("enclosures"),
    )
    return articles.select("feed_id", feeds.described(articles).alias("description"))


@query("earliest_dates", """SELECT o_orderkey AS feed_id, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || 'T10:00:00+00:00' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:30:00+09:00' END AS published FROM orders""")
def earliest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two machine dates with unlike offsets: the earlier instant counts, whatever its text, and keeps its offset."""
    markup = '<article><h2><a href="/o/%1$d">Order number %1$d</a></h2><time datetime="%2$sT00:30:00+09:00">a</time><time datetime="%3$sT%4$s:00:00Z">b</time></article>'
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.date_sub("o_orderdate", 1), "yyyy-MM-dd").alias("before"), F.when(F.col("o_orderstatus") == "F", "10").otherwise("20").alias("hour"))
    pages = bodies(o, "o_orderkey", markup, "o_orderkey", "day", "before", "hour").withColumn("content_type", F.lit("text/html"))
    got = feeds.json_items(selectors.query(pages, {"selectors": {"items": {"selector": "article"}, "title": {"selector": "h2"}}}))
    return got.select("feed_id", F.col("item.date_published").alias("published"))


@query("selected_and_found", """SELECT p_partkey AS feed_id, CAST(position AS INTEGER) AS position, 'https://shop.example/' || way || '/' || p_partkey AS url, scraper FROM part, (VALUES (0, 'a', 'selectors'), (1, 'b', 'selectors'), (3, 'c', 'semantic_html')) AS w(position, way, scraper)""")
def selected_and_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector articles and automatic ones of the same pages: what both found stays once, from the selectors."""
    markup = '<body><ul><li><a href="/a/%1$d">A</a></li><li><a href="/b/%1$d">B</a></li></ul><div><a href="/b/%1$d">B</a></div><div><a href="/c/%1$d">%2$s</a></div></body>'
    pages = bodies(table(spark, sf_dir, "part"), "p_partkey", markup, "p_partkey", "p_name").withColumn("content_type", F.lit("text/html"))
    one, two = ({"selectors": {"items": {"selector": s, "enhance": False}, "url": {"selector": "a", "extractor": "href"}}} for s in ("li", "div"))
    return admission.united(selectors.query(pages, one), selectors.query(pages, two).withColumn("scraper", F.lit("semantic_html"))).select("feed_id", "position", "url", "scraper")


def part_pages(spark: SparkSession, sf_dir: str, html) -> DataFrame:
    """A page per part, its markup by a column expression over key and size."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").cast("long").alias("page_id"), html.alias("html"))


def part_nodes(spark: SparkSession, sf_dir: str, html, columns=clusters.NODES) -> DataFrame:
    """The node relation of a page per part, its markup by a column expression."""
    return shared.written(shred.shred(part_pages(spark, sf_dir, html), columns=columns), "nodes")


@query("cluster_containers", """SELECT p_partkey AS page_id, signature, CAST(size AS BIGINT) AS size, signature = 'row' AND k > 1 AS contains
FROM (SELECT p_partkey, p_size % 3 + 1 AS k FROM part) AS p, LATERAL (VALUES ('row', 2), ('card', 2 * k), ('mark', 4 * k)) AS g(signature, size)""")
def cluster_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of one to three cards, each with two marks: a row is a container if it has two cards; marks are no layout."""
    card = '<div class="card"><i class="mark">a</i><i class="mark">b</i></div>'
    row = F.concat(F.lit('<div class="row">'), F.repeat(F.lit(card), (F.col("p_size") % 3 + 1).cast("int")), F.lit("</div>"))
    groups, members = clusters.grouped(part_nodes(spark, sf_dir, F.concat(F.lit('<main class="only">'), row, row, F.lit("</main>"))))
    found = clusters.containers(groups, members).withColumn("contains", F.lit(True))
    return groups.join(found, clusters.GROUP, "left").select("page_id", "signature", "size", F.coalesce("contains", F.lit(False)).alias("contains"))


@query("cluster_overlaps", """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 AND p_size >= CAST(0.8 AS DOUBLE) * (p_size + 3) THEN 'inner' ELSE 'outer' END AS signature FROM part""")
def cluster_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wrappers one in the other: the topmost goes first; the innermost stays if it has most of the words and is of layout elements."""
    tag = F.when(F.col("p_partkey") % 2 == 0, "div").otherwise("span")
    inner = F.concat(F.lit("<"), tag, F.lit(' class="inner">'), F.repeat(F.lit("word "), F.col("p_size")), F.lit("</"), tag, F.lit(">"))
    stack = F.concat(F.lit('<section class="top"><div class="outer">three more words '), inner, F.lit("</div></section>"))
    groups, members = clusters.grouped(part_nodes(spark, sf_dir, F.concat(stack, stack)))
    return clusters.resolved(groups, members).select("page_id", "signature")


@query("cluster_scores", """WITH g AS (SELECT p_partkey AS page_id, unnest([{'s': 'a', 'v': 4.0 + CASE WHEN p_size % 2 = 1 THEN 20 ELSE 0 END, 'i': 0}, {'s': 'b', 'v': 5.0 + CASE WHEN p_size // 2 % 2 = 1 THEN 20 ELSE 0 END, 'i': 1}, {'s': 'c', 'v': 4.0 + CASE WHEN p_size % 5 = 0 THEN 40 ELSE 0 END, 'i': 2}]) AS g FROM part)
SELECT page_id, first(g.s ORDER BY g.v DESC, g.i) AS signature, CAST(max(g.v) AS DOUBLE) AS score FROM g GROUP BY page_id""")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ten words an element, with a heading, a time or a month's name deep in one element each; one of few words is larger but does not count."""

    def group(name: str, n: int, plain: str, marked: str, test) -> list:
        one = f'<div class="{name}">{"word " * 9}<p><b>%s</b></p></div>'
        return [F.lit(one % plain * (n - 1)), F.when(test, one % marked).otherwise(one % plain)]

    small = f'<div class="small">{"word " * 4}</div>' * 6
    size = F.col("p_size")
    parts = [F.lit(small), *group("a", 2, "word", "<h4>word</h4>", size % 2 == 1), *group("b", 3, "word", '<u datetime="x">word</u>', F.floor(size / 2) % 2 == 1), *group("c", 2, "Marx", "Mar", size % 5 == 0)]
    best, _ = clusters.best_cluster(part_nodes(spark, sf_dir, F.concat(*parts)))
    return best.select("page_id", "signature", "score")


@query("cluster_feed", """SELECT p_partkey AS feed_id, CAST(position AS INTEGER) AS position, p_name || ' of number ' || n AS title, 'https://shop.example/list#' || n || '-' || p_partkey AS url FROM part, (VALUES (0, 'one'), (1, 'two'), (2, 'three')) AS w(position, n)
UNION ALL SELECT p_partkey + 1000000, CAST(position AS INTEGER), p_name || ' is item ' || n, 'https://shop.example/posts/' || n || '/' || p_partkey FROM part, (VALUES (0, 'one'), (1, 'two')) AS w(position, n)""")
def cluster_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without links give their best cluster, whose cards get the address of their id; pages with a link list give that."""
    cards = "".join(f'<div class="card" id="{n}-%1$d"><h3>%2$s of number {n}</h3><p>Some more words about it.</p></div>' for n in ("one", "two", "three"))
    links = "".join(f'<li><a href="/posts/{n}/%1$d">%2$s is item {n}</a></li>' for n in ("one", "two"))
    p = table(spark, sf_dir, "part")
    bare = bodies(p, "p_partkey", f"<body><main>{cards}</main></body>", "p_partkey", "p_name")
    linked = bodies(p, "p_partkey", f"<body><main>{cards}<ul>{links}</ul></main></body>", "p_partkey", "p_name").withColumn("feed_id", F.col("feed_id") + 1000000)
    pages = shared.written(bare.unionByName(linked), "pages")
    return auto.list_articles(pages, anchorless=True).select("feed_id", "position", "title", "url")


@query("parent_cards", """SELECT p_partkey AS feed_id, CAST(i AS INTEGER) AS position, 'https://shop.example/' || i || '/' || p_partkey AS url,
 CASE i WHEN 0 THEN p_brand || chr(10) || p_name || ' is new' WHEN 1 THEN 'Inside ' || p_name END AS description, CASE WHEN i = 0 THEN '2024-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS published, CASE WHEN i = 0 THEN [p_brand] ELSE [] END AS categories
FROM part, range(0, 5) AS r(i)""")
def parent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as items: the first has its text, date and topic beside it, two wrappers up; the second has a text of its own;
    the third shares its box with another link, the fourth with a second heading; the fifth stands alone in the page's menu."""
    markup = (
        '<body><main><div><div><p><a class="item" href="/0/%1$d">First of %2$s</a></p></div><span class="topic">%3$s</span><p>%2$s is new</p><p>2024-03-%4$02d</p></div>'
        '<div><a class="item" href="/1/%1$d"><h3>Second of %2$s</h3><p>Inside %2$s</p></a><p>outside</p></div>'
        '<div><b><a class="item" href="/2/%1$d">Third of %2$s</a></b><p>A text. <a href="/other">Another</a></p></div>'
        '<div><b><a class="item" href="/3/%1$d">Fourth of %2$s</a></b><h2>One</h2><h3>Two</h3><p>text</p></div></main>'
        '<nav><ul><li><a class="item" href="/4/%1$d">Fifth of %2$s</a></li></ul></nav></body>'
    )
    p = table(spark, sf_dir, "part").withColumn("day", F.col("p_size") % 28 + 1)
    pages = bodies(p, "p_partkey", markup, "p_partkey", "p_name", "p_brand", "day").withColumn("content_type", F.lit("text/html"))
    got = selectors.query(pages, {"selectors": {"items": {"selector": "a.item"}}})
    return got.select("feed_id", "position", "url", "description", F.col("published_at_raw").alias("published"), "categories")


@query("captured_by_path", """SELECT p_partkey AS feed_id, 'list' AS strategy, CASE WHEN p_size % 2 = 0 THEN 'div.big' ELSE 'main > div' END AS selector, CAST(2 AS BIGINT) AS matches FROM part WHERE p_size <= 25""")
def captured_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles known by another host's addresses: links match by the end of the URL, and their headings stand for the cards
    around them, which share a class or only a path. Large parts have articles the page does not lead to."""
    card = '<div class="%3$s"><h3><a href="/n/{0}/%1$d">Item {0} of %2$s</a></h3><p><a href="/tag/%1$d">tag</a></p></div>'
    p = table(spark, sf_dir, "part").withColumn("names", F.when(F.col("p_size") % 2 == 0, "card big").otherwise(""))
    pages = bodies(p, "p_partkey", f"<body><main>{card.format('one')}{card.format('two')}</main></body>", "p_partkey", "p_name", "names")
    end = F.when(F.col("p_size") <= 25, F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(F.lit("/none"))
    articles = p.select(F.col("p_partkey").alias("feed_id"), F.explode(F.array(*[F.concat(F.lit(f"https://mirror.example/x/n/{n}"), end) for n in ("one", "two")])).alias("url"))
    return auto.capture(shared.written(pages, "pages"), articles)


@query("registrable_domains", """WITH h AS (SELECT p_partkey AS feed_id, p_partkey AS k, 'n' || (p_partkey % 25) AS cc, p_size % 7 AS shape FROM part)
SELECT feed_id, CASE shape WHEN 0 THEN 'shop' || k || '.co.' || cc WHEN 1 THEN 'shop' || k || '.' || cc WHEN 2 THEN 'y' || k || '.any.w' || cc WHEN 3 THEN 'www.w' || cc WHEN 4 THEN 'co.' || cc WHEN 5 THEN 'b.unknown' || k ELSE '10.0.0.' || (k % 256) END AS domain FROM h""")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of seven shapes under suffix rules made of nation numbers: plain, two-label, wildcard, exception, a suffix itself, unknown, an address."""
    cc = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    lines = table(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("// list"), cc, F.concat(F.lit("CO."), cc), F.concat(F.lit("*.w"), cc), F.concat(F.lit("!www.w"), cc, F.lit(" note")))).alias("value"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).alias("shape"), F.col("p_partkey").cast("string").alias("k"), F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("cc"))
    shapes = ("www.shop%1$s.co.%2$s", "a.b.shop%1$s.%2$s", "x.y%1$s.any.w%2$s", "x.www.w%2$s", "co.%2$s", "a.b.unknown%1$s")
    host = F.when(F.col("shape") == 6, F.concat(F.lit("10.0.0."), (F.col("p_partkey") % 256).cast("string")))
    for i, shape in enumerate(shapes):
        host = host.when(F.col("shape") == i, F.format_string(shape, "k", "cc"))
    hosts = p.select(F.col("p_partkey").alias("feed_id"), F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":8443/list")).alias("url"))
    return domains.with_domain(hosts, domains.rules(lines)).select("feed_id", "domain")


def part_server(url: str, headers: dict, seconds: float, most: int, peer_allowed) -> tuple[int, dict, bytes]:
    """A transport that plays a server: /kind/number."""
    kind, _, number = url.split("/", 3)[3].partition("/")
    if kind.startswith("r") and kind != "r0":
        return 302, {"Location": f"/r{int(kind[1:]) - 1}/{number}"}, b""
    if kind == "away":
        return 301, {"location": f"https://other.example/r0/{number}"}, b""
    if kind == "down":
        return 307, {"Location": f"http://shop.example/r0/{number}"}, b""
    if kind == "large":
        return 200, {}, b"x" * (most + 1)
    if kind == "slow":
        raise TimeoutError
    if kind == "inside":
        peer_allowed("10.1.2.3")
    return 200, {"Content-Type": "text/html"}, f"<p>page {number}</p>".encode()


@query("fetched_pages", """WITH p AS (SELECT p_partkey AS feed_id, p_partkey % 11 AS kind FROM part)
SELECT feed_id, CAST(CASE WHEN kind <= 5 THEN 200 END AS INTEGER) AS status, CAST(CASE WHEN kind <= 6 THEN kind WHEN kind <= 8 THEN 1 ELSE 0 END AS INTEGER) AS hops,
 CASE WHEN kind <= 5 THEN NULL WHEN kind = 6 THEN 'too_many_redirects' WHEN kind = 7 THEN 'unsupported_url_scheme' WHEN kind = 8 THEN 'cross_origin_follow_up' WHEN kind = 9 THEN 'response_too_large' WHEN kind = 10 THEN 'private_network' END AS error,
 CASE WHEN kind <= 5 THEN 'https://shop.example/r0/' || feed_id END AS final_url FROM p""")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part from a server that redirects up to six times, leaves the origin or TLS, answers at length or sits in a private net."""
    kinds = F.array(*[F.lit(f"r{k}") for k in range(7)], *map(F.lit, ("down", "away", "large", "inside")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feed_id"), F.concat(F.lit("https://shop.example/"), F.get(kinds, (F.col("p_partkey") % 11).cast("int")), F.lit("/"), F.col("p_partkey").cast("string")).alias("url"))
    requests = p.select("*", F.lit("https://shop.example/").alias("origin"), F.lit("pagination").alias("relation"))
    got = fetch.fetch(requests, part_server, fetch.Limits(max_bytes=10_000))
    return got.select("feed_id", F.when(F.col("error").isNull(), F.col("status")).alias("status"), "hops", "error", F.when(F.col("error").isNull(), F.col("final_url")).alias("final_url"))


@query("byte_budget", """WITH c AS (SELECT conv_id, list({'t': strlen(text)::BIGINT, 'k': [turn]} ORDER BY turn) FILTER (WHERE strlen(text) BETWEEN 1 AND 900) AS rows FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_prepend({'t': 0::BIGINT, 'k': []::BIGINT[]}, rows), lambda acc, r: CASE WHEN acc.t + r.t <= 1500 THEN {'t': acc.t + r.t, 'k': list_concat(acc.k, r.k)} ELSE acc END) AS got FROM c WHERE rows IS NOT NULL)
SELECT conv_id, unnest(got.k) AS turn FROM f""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a conversation's captures: those of 900 bytes at most that fit into 1,500 in order; a long one does not stop shorter ones."""
    return captures.within_budget(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 900, 1500).select("conv_id", "turn")


@query("page_addresses", """SELECT p_partkey AS page_id, CASE p_size % 6 WHEN 0 THEN 'https://shop.example/c/' || p_partkey WHEN 1 THEN 'https://shop.example/o/' || p_partkey WHEN 2 THEN 'https://shop.example/t/' || p_partkey ELSE 'https://shop.example/b/' END AS url FROM part WHERE p_size % 6 < 4""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical link, og:url, twitter:url, base: the first kind whose first element is an absolute address; relative and blank ones do not count."""
    kind = F.col("p_size") % 6
    key = F.col("p_partkey").cast("string")
    parts = [
        F.when(kind == 5, "").otherwise('<base target="x"><base href="https://shop.example/b/">'),
        F.when(kind == 2, F.concat(F.lit('<meta name="twitter:url" content=" HTTPS://Shop.example/t/'), key, F.lit(' ">'))).otherwise(""),
        F.when(kind == 1, F.concat(F.lit('<meta property="og:url" content="https://shop.example/o/'), key, F.lit('">'))).otherwise('<meta property="og:url" content=" ">'),
        F.when(kind == 0, F.concat(F.lit('<link rel="canonical" href="https://shop.example/c/'), key, F.lit('">'))).otherwise('<link rel="canonical" href="/relative"><link rel="canonical" href="https://shop.example/second">'),
    ]
    html = F.when(kind == 4, "<html><body>none</body></html>").otherwise(F.concat(F.lit("<html><head>"), *parts, F.lit("</head><body></body></html>")))
    return discovery.page_urls(part_nodes(spark, sf_dir, html, discovery.NODES))


@query("alternate_feeds", """SELECT p_partkey AS page_id, CAST(position AS INTEGER) AS position, way || p_partkey AS href, 'application/' || kind || '+xml' AS mime_type FROM part, (VALUES (0, '/rss/', 'rss'), (1, '/atom/', 'atom')) AS w(position, way, kind)""")
def alternate_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two native feeds in the head among other links, one without a type, one blank, one in the body."""
    html = F.format_string(
        '<html><head><link rel="alternate" type="text/html" href="/no"><link rel="alternate" href="/no"><link rel="home Alternate" type="application/rss+xml" href="/no">'
        '<link rel="home alternate" type=" Application/RSS+xml; charset=utf-8" href=" /rss/%1$d "><link rel="alternate" type="application/rss+xml" href=" "><link rel="alternate" type="application/atom+xml" href="/atom/%1$d"></head>'
        '<body><link rel="alternate" type="application/rss+xml" href="/no"></body></html>',
        "p_partkey",
    )
    return discovery.alternate_feeds(part_nodes(spark, sf_dir, html, discovery.NODES))


@query("sitemap_discovery", """WITH p AS (SELECT p_partkey AS feed_id, p_partkey % 4 AS kind FROM part)
SELECT feed_id, CAST(0 AS INTEGER) AS position, 'https://p' || feed_id || '.example/direct' AS url FROM p WHERE kind = 0
UNION ALL SELECT feed_id, CAST(i AS INTEGER), 'https://p' || feed_id || '.example/linked/' || i FROM p, range(0, 2) AS r(i) WHERE kind = 1
UNION ALL SELECT feed_id, CAST(i AS INTEGER), 'https://p' || feed_id || '.example/sub/' || i FROM p, range(0, 3) AS r(i) WHERE kind = 2""")
def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are a sitemap, link to one, have an index at the usual place (three of its four sitemaps are read), or none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("page_id"), (F.col("p_partkey") % 4).alias("kind"), F.format_string("https://p%d.example", "p_partkey").alias("site"))
    html = F.when(F.col("kind") == 0, F.format_string('<?xml version="1.0"?><s:urlset xmlns:s="x"><s:url><s:loc>%s/direct</s:loc></s:url></s:urlset>', "site")).when(F.col("kind") == 1, '<html><head><link rel="sitemap" href="/maps/own.xml"></head><body></body></html>').otherwise("<html><body>x</body></html>")
    pages = shared.written(p.select("page_id", "kind", "site", F.concat("site", F.lit("/list")).alias("url"), html.alias("html")), "pages")
    linked = F.format_string("<urlset><url><loc>%1$s/linked/0</loc></url><url><loc><![CDATA[%1$s/linked/1]]></loc><priority>0.9</priority></url><url><loc>%1$s/low</loc><priority>0.1</priority></url></urlset>", "site")
    index = F.concat(F.lit("<sitemapindex>"), *[F.format_string(f"<sitemap><loc>%s/m{k}.xml</loc></sitemap>", "site") for k in range(4)], F.lit("</sitemapindex>"))
    store = pages.where("kind = 1").select(F.concat("site", F.lit("/maps/own.xml")).alias("url"), linked.alias("body"))
    two = pages.where("kind = 2")
    store = store.unionByName(two.select(F.concat("site", F.lit("/sitemap.xml")).alias("url"), index.alias("body")))
    for k in range(4):
        store = store.unionByName(two.select(F.format_string(f"%s/m{k}.xml", "site").alias("url"), F.format_string(f"<urlset><url><loc>%s/sub/{k}</loc></url></urlset>", "site").alias("body")))
    nodes = shared.written(shred.shred(pages, columns=discovery.NODES), "nodes")
    return discovery.sitemap_entries(nodes, pages, store, "2024-01-01").select("feed_id", "position", "url")


@query("page_summaries", """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 4 AS kind, p_size % 8 AS k FROM part)
SELECT page_id, kind <> 3 AS html_response, kind = 1 AS scheme_downgrade, CAST(CASE kind WHEN 0 THEN 5 WHEN 1 THEN 5 + 2 * k WHEN 2 THEN 4 ELSE 2 END AS BIGINT) AS node_count, CAST(CASE WHEN kind = 1 AND k > 1 THEN k ELSE 0 END AS BIGINT) AS segments,
 CAST(CASE WHEN kind = 1 AND k > 1 THEN least(k, 5) ELSE 0 END AS INTEGER) AS samples, CAST(CASE WHEN kind = 0 THEN 1 ELSE 0 END AS INTEGER) AS feeds, CASE WHEN kind = 2 THEN 'cloudflare_interstitial' END AS blocked,
 CASE WHEN kind = 0 THEN 'done' WHEN kind = 1 AND k > 1 THEN 'capture_config' ELSE 'scrape_url' END AS next_step FROM p""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a native feed, with a list of up to seven links, behind a check, and without markup; what was seen and the next step."""
    kind, k = F.col("p_partkey") % 4, F.col("p_size") % 8
    item = '<li><a href="/posts/one/{0}">A story of many words {0}</a></li>'
    items = F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i < k, F.replace(F.lit(item), F.lit("{0}"), i.cast("string"))).otherwise("")), "")
    html = (
        F.when(kind == 0, '<html><head><link rel="alternate" type="application/rss+xml" href="/rss"></head><body><p>text</p></body></html>')
        .when(kind == 1, F.concat(F.lit("<html><head></head><body><main><ul>"), items, F.lit("</ul></main></body></html>")))
        .when(kind == 2, "<html><head><title>Just a moment...</title></head><body>Checking your browser before accessing</body></html>")
        .otherwise("<html><body>plain words</body></html>")
    )
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").cast("long").alias("page_id"), F.lit("https://shop.example/list").alias("url"), F.when(kind == 1, "http://shop.example/list").otherwise("https://shop.example/list").alias("final_url"),
        F.lit(200).alias("status"), F.when(kind == 3, "text/plain").otherwise("text/html; charset=utf-8").alias("content_type"), html.alias("html"),
    )
    pages = shared.written(p, "pages")
    nodes = shared.written(shred.shred(pages, columns=diagnostics.NODES), "nodes")
    articles = auto.list_articles(pages.select(F.col("page_id").alias("feed_id"), "url", F.col("html").alias("body")))
    got = diagnostics.summary(pages, nodes, shared.written(articles, "articles"))
    step = diagnostics.inspect_outcome(F.col("alternate_feeds"), F.col("articles_count"))["next_step"]
    return got.select("page_id", "html_response", "scheme_downgrade", "node_count", "segments", F.size("sample_paths").alias("samples"), F.size("alternate_feeds").alias("feeds"), F.col("blocked_surface").alias("blocked"), step.alias("next_step"))


@query("outcomes", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind, o_orderkey // 6 % 3 AS n, o_orderkey // 18 % 2 = 0 AS flag FROM orders)
SELECT k, CASE kind WHEN 3 THEN NOT flag WHEN 4 THEN n > 0 WHEN 5 THEN FALSE ELSE TRUE END AS ok, CASE kind WHEN 0 THEN CASE WHEN flag THEN 'done' WHEN n > 0 THEN 'capture_config' ELSE 'scrape_url' END WHEN 1 THEN CASE WHEN n > 0 THEN 'done' WHEN flag THEN 'inspect_url' ELSE 'read_runtime' END
 WHEN 2 THEN CASE WHEN n > 0 AND flag THEN 'validate_config' ELSE 'inspect_url' END WHEN 3 THEN CASE WHEN flag THEN 'validate_config' ELSE 'apply_config' END WHEN 4 THEN CASE WHEN n > 0 THEN 'done' ELSE 'inspect_url' END
 ELSE CASE n WHEN 0 THEN 'read_runtime' WHEN 1 THEN 'validate_config' ELSE 'inspect_url' END END AS next_step FROM o""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every kind of call over counts and flags made of order numbers."""
    n, flag = F.floor(F.col("o_orderkey") / 6) % 3, F.floor(F.col("o_orderkey") / 18) % 2 == 0
    some = F.when(flag, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    calls = (
        diagnostics.inspect_outcome(some, n), diagnostics.scrape_outcome(n, flag), diagnostics.capture_outcome(n, F.when(flag, "li")), diagnostics.validate_outcome(some),
        diagnostics.apply_outcome(n), diagnostics.error_outcome(F.get(F.array(*map(F.lit, ("renderer_not_configured", "config_and_yaml", "other"))), n.cast("int"))),
    )
    out = F.get(F.array(*calls), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), out.alias("o")).select("k", "o.ok", "o.next_step")


@query("semantic_roots", """SELECT p_partkey AS page_id, CAST(position - p_size % 2 AS INTEGER) AS position, tag, CAST(depth AS INTEGER) AS depth
FROM part, (VALUES (0, 'li', 5), (1, 'div', 4), (2, 'article', 3), (3, 'section', 3), (4, 'section', 3)) AS w(position, tag, depth) WHERE (p_size % 2 = 0 AND position < 4) OR (p_size % 2 = 1 AND position > 0)""")
def semantic_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf containers, deepest first: a section around a list item gives way to it, a div around a div, chrome counts for nothing."""
    item = F.when(F.col("p_size") % 2 == 0, "<ul><li>item</li></ul>").otherwise("<ul><b>none</b></ul>")
    html = F.concat(F.lit("<html><body><nav><ul><li>menu</li></ul></nav><main><article>a</article><section>s</section><section><p>"), item, F.lit("</p></section><div><p><div>leaf</div></p></div></main></body></html>"))
    nodes = shred.shred(part_pages(spark, sf_dir, html), columns=("page_id", "node_id", "last_desc", "tag", "depth", "chrome", "non_leaf"))
    return segments.semantic(nodes).select("page_id", "position", "tag", "depth")


@query("chosen_links", """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 5 AS kind FROM part)
SELECT page_id, CASE kind WHEN 0 THEN '/zzz/one/' WHEN 1 THEN '/posts/some-long-slug/' WHEN 2 THEN '/news/' ELSE '/zzz/' END || page_id AS href, CAST(CASE kind WHEN 0 THEN 130 WHEN 3 THEN 10 ELSE 20 END AS INTEGER) AS points FROM p WHERE kind < 4""")
def chosen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's link: the heading's before others, content before a utility page, text before an image with the same target,
    outside before inside an aside; a card with a menu only has none."""
    cards = (
        '<a href="/posts/some-long-slug/%1$d">Other</a><h3><a href="/zzz/one/%1$d">The title</a></h3><h4><a href="/posts/x">Later</a></h4>',
        '<a href="/about">About</a><a href="/posts/some-long-slug/%1$d">A post</a><a href="/zzz/%1$d">Plain</a>',
        '<a href="/news/%1$d#top"><b><img src="x"></b></a><p><a href="/news/%1$d">Some news</a></p><a href="/news/other">More news</a>',
        '<aside><a href="/posts/some-long-slug/%1$d">Aside</a></aside><a href="/zzz/%1$d">Plain</a><a href="#x">Here</a>',
        '<a href="/login">Login</a><a href="/tags/x">Tag</a>',
    )
    markup = F.get(F.array(*[F.format_string(c, "p_partkey") for c in cards]), (F.col("p_partkey") % 5).cast("int"))
    html = F.concat(F.lit("<html><body><main><ul><li>"), markup, F.lit("</li></ul></main></body></html>"))
    nodes = part_nodes(spark, sf_dir, html, segments.CONTAINED)
    pages = nodes.select("page_id").distinct().withColumn("url", F.lit("https://shop.example/list"))
    return segments.primary_links(nodes, segments.semantic(nodes), pages).select("page_id", "href", "points")


@query("channel_headers", """SELECT p_partkey AS feed_id, CAST(CASE WHEN p_size % 3 = 0 THEN 360 ELSE ceil(p_size * 50 / 60.0) END AS INTEGER) AS ttl, CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'fr' END AS language,
 TIMESTAMP '2024-03-01' + to_hours(CAST(p_size AS INTEGER)) AS last_build_date, CASE WHEN p_size % 5 > 0 THEN 'https://img.example/' || p_partkey || '.png' END AS image, p_name AS author, p_brand || ' & more' AS description FROM part""")
def channel_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by response headers and meta tags: age limits in minutes, the header's language before the page's, dates, an image's address in a text."""
    markup = '<html lang="fr"><head><meta name="author" content="%2$s"><meta content="%3$s &amp; more" name="description"><meta property="og:image" content="%4$s"></head><body></body></html>'
    p = table(spark, sf_dir, "part").withColumn("shot", F.when(F.col("p_size") % 5 == 0, "no address").when(F.col("p_size") % 5 == 1, F.format_string(" see https://Img.example:443/%d.png", "p_partkey")).otherwise(F.format_string("https://img.example/%d.png", "p_partkey")))
    stamp = F.concat(F.date_format(F.timestamp_add("HOUR", F.col("p_size"), F.lit("2024-03-01").cast("timestamp")), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    pairs = F.array(
        F.struct(F.lit("last-modified").alias("k"), stamp.alias("v")),
        F.struct(F.lit("cache-control").alias("k"), F.when(F.col("p_size") % 3 == 0, "no-store").otherwise(F.format_string("public, max-age=%d", F.col("p_size") * 50)).alias("v")),
        F.struct(F.lit("content-language").alias("k"), F.when(F.col("p_size") % 2 == 0, "de-AT, en").otherwise("").alias("v")),
    )
    pages = p.select(F.col("p_partkey").alias("feed_id"), F.lit("https://shop.example/").alias("url"), F.format_string(markup, "p_partkey", "p_name", "p_brand", "shot").alias("body"), F.map_from_entries(pairs).alias("headers"))
    return feeds.channels(pages).select("feed_id", "ttl", "language", "last_build_date", "image", "author", "description")
