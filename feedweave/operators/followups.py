"""Follow-up sources as columns: posts endpoints and their archive scope, post lists, sitemaps, oEmbed payloads.

Requests are URLs in a column; what they return is a table of stored responses, joined by ``paging.follow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import urls
from feedweave.functions.texts import collapse
from feedweave.operators.feeds import unescape

POSTS = "array<struct<title:struct<rendered:string>,content:struct<rendered:string>,excerpt:struct<rendered:string>,link:string,date:string,categories:array<string>>>"


def present(x: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(x), F.lit(""))


def archive_path(segments: Column) -> Column:
    """The segments from the first four-digit one on, if at most two numbers follow it; else null."""
    at = F.array_position(F.transform(segments, lambda s: F.regexp_like(s, F.lit(r"^\d{4}$"))), True)
    tail = F.when(at > 0, F.slice(segments, at.cast("int"), F.size(segments)))
    return F.when((F.size(tail) <= 3) & F.forall(tail, lambda s: F.regexp_like(s, F.lit(r"^\d+$"))), tail)


def archive_bounds(segments: Column) -> Column:
    """struct(after, before) of a year, month or day archive path; null for other paths and dates that do not exist.

    A month or day out of its range counts as absent, so that the archive widens.
    """
    return let(archive_path(segments), _bounds)


def _bounds(tail: Column) -> Column:
    def number(i: int, most: int) -> Column:
        n = F.get(tail, F.lit(i)).try_cast("int")
        return F.when(n.between(1, most), n)

    month, day = number(1, 12), number(2, 31)
    text = F.concat_ws("-", F.get(tail, F.lit(0)), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0"))
    start = F.when(tail.isNotNull(), text).try_cast("date")
    end = F.when(day.isNotNull(), F.date_add(start, 1)).when(month.isNotNull(), F.add_months(start, 1)).otherwise(F.add_months(start, 12))
    stamp = "yyyy-MM-dd'T00:00:00Z'"
    return F.when(start.isNotNull(), F.struct(F.date_format(start, stamp).alias("after"), F.date_format(end, stamp).alias("before")))


def archive_scope(body_class: Column, url: Column) -> Column:
    """struct(query map, fetchable, reason) of a listing page, from its body classes and path.

    Categories, tags and authors need the number in a class; dates need bounds; single pages are no archive.
    """
    segments = urls.path_segments(url)
    query_page = F.nullif(F.regexp_extract(urls.part(url, "query"), r"(?:^|&)paged=0*([1-9]\d*)(?:&|$)", 1), F.lit(""))
    given = F.struct(F.split(F.coalesce(body_class, F.lit("")), r"\s+").alias("classes"), segments.alias("segments"), query_page.alias("query_page"))

    def paging(g: Column) -> Column:
        segments = g["segments"]
        page = F.try_element_at(segments, F.lit(-1)).try_cast("int")
        paged = F.coalesce((F.size(segments) >= 2) & (F.try_element_at(segments, F.lit(-2)) == "page") & (page >= 1), F.lit(False))
        path = F.when(paged, F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 2, F.lit(0)))).otherwise(segments)
        return F.struct(g["classes"].alias("classes"), path.alias("path"), F.coalesce(g["query_page"], F.when(paged, page.cast("string"))).alias("number"))

    def dating(g: Column) -> Column:
        return F.struct(g["classes"].alias("classes"), g["path"].alias("path"), g["number"].alias("number"), archive_bounds(g["path"]).alias("bounds"), archive_path(g["path"]).isNotNull().alias("dated"))

    # each step is bound once, as the next one uses it many times
    return let(let(let(given, paging), dating), _scope)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array binds it to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scope(g: Column) -> Column:
    classes, path, number, bounds = g["classes"], g["path"], g["number"], g["bounds"]
    head = F.get(path, F.lit(0))

    def has(name: str) -> Column:
        return F.array_contains(classes, name) | F.coalesce(head == name, F.lit(False))

    def ident(name: str) -> Column:
        return F.get(F.filter(F.transform(classes, lambda c: F.regexp_extract(c, rf"^{name}-(\d+)$", 1)), lambda x: x != ""), F.lit(0))

    dated = F.array_contains(classes, "date") | g["dated"]
    single = F.arrays_overlap(classes, F.array(*map(F.lit, ("page", "single", "singular", "attachment")))) | F.exists(classes, lambda c: F.regexp_like(c, F.lit(r"^(page-id|postid)-\d+$")))
    none = F.create_map().cast("map<string,string>")

    def state(query: Column, ok: Column, reason: str) -> Column:
        extra = F.when(number.isNotNull(), F.create_map(F.lit("page"), number)).otherwise(none)
        return F.when(ok, F.struct(F.map_concat(F.coalesce(query, none), extra).alias("query"), F.lit(True).alias("fetchable"), F.lit(reason).alias("reason"))).otherwise(
            F.struct(none.alias("query"), F.lit(False).alias("fetchable"), F.lit("unsupported_archive").alias("reason"))
        )

    def by(name: str, key: str) -> Column:
        return state(F.when(ident(name).isNotNull(), F.create_map(F.lit(key), ident(name))), ident(name).isNotNull(), "archive")

    dates = state(F.when(bounds.isNotNull(), F.create_map(F.lit("after"), bounds["after"], F.lit("before"), bounds["before"])), bounds.isNotNull(), "archive")
    return (
        F.when(has("category"), by("category", "categories"))
        .when(has("tag"), by("tag", "tags"))
        .when(has("author"), by("author", "author"))
        .when(dated, dates)
        .when(F.array_contains(classes, "archive"), state(none, F.lit(False), "archive"))
        .when(single, F.struct(none.alias("query"), F.lit(False).alias("fetchable"), F.lit("non_archive").alias("reason")))
        .otherwise(state(none, F.lit(True), "unscoped"))
    )


def posts_url(api_root: Column, query: Column) -> Column:
    """The posts endpoint below an API root: its path, or its rest_route value where the root has one. query: a map."""
    pairs = F.array_join(F.transform(F.map_entries(query), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), "&")
    own = F.coalesce(urls.part(api_root, "query"), F.lit(""))
    route = F.rtrim(F.regexp_replace(F.regexp_extract(own, r"(?:^|&)rest_route=([^&]*)", 1), "%2F", "/"), F.lit("/"))
    styled = F.regexp_like(own, F.lit(r"(^|&)rest_route="))
    base = F.regexp_extract(api_root, r"^([^?#]*)", 1)
    rest = F.filter(F.split(own, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("rest_route=")))
    path = F.when(styled, base).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/wp/v2/posts")))
    routed = F.when(styled, F.array(F.concat(F.lit("rest_route="), F.url_encode(F.concat(route, F.lit("/wp/v2/posts")))))).otherwise(F.array().cast("array<string>"))
    values = F.array_join(F.filter(F.concat(routed, rest, F.array(pairs)), lambda p: p != ""), "&")
    return F.concat(path, F.when(values != "", F.concat(F.lit("?"), values)).otherwise(""))


def posts(bodies: DataFrame) -> DataFrame:
    """feed_id, url (of the page), body (a JSON list of posts) to article columns; posts without a link go."""
    p = bodies.select("feed_id", "url", F.posexplode(F.from_json("body", POSTS)).alias("position", "p"))
    link = urls.resolve(present(F.col("p.link")), F.col("url"))
    p = p.select("feed_id", "position", "p", link.alias("url")).where("url is not null")
    root = urls.part(F.col("url"), "path").isin("", "/") & (urls.part(F.col("url"), "query") != "")
    ident = F.when(root, F.concat(F.lit("/?"), urls.part(F.col("url"), "query"))).otherwise(F.coalesce(F.nullif(urls.part(F.col("url"), "path"), F.lit("")), F.col("url")))
    return p.select(
        "feed_id",
        "position",
        ident.alias("id"),
        present(collapse(unescape(F.regexp_replace("p.title.rendered", "(?s)<[^>]*>", " ")))).alias("title"),
        F.coalesce(present(F.col("p.content.rendered")), present(F.col("p.excerpt.rendered"))).alias("description"),
        "url",
        present(F.col("p.date")).alias("published_at_raw"),
        F.filter(F.transform(F.coalesce("p.categories", F.array().cast("array<string>")), F.trim), lambda c: c != "").alias("categories"),
    )


def _inner(x: Column, name: str, prefix: str = r"(?:[\w-]+:)?") -> Column:
    """Text of the first element of a local name, null without one. prefix: a pattern."""
    raw = F.regexp_extract(x, rf"(?s)<{prefix}{name}(?:\s[^>]*)?>(.*?)</{prefix}{name}\s*>", 1)
    return present(unescape(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


SITEMAP = "url array<struct<loc:string,lastmod:string,priority:string,changefreq:string,news:struct<publication_date:string,title:string>>>, sitemap array<struct<loc:string>>"


def _read_sitemap(body: Column) -> Column:
    """A sitemap or an index as SITEMAP, by local names; of broken XML the elements that are whole."""

    def parts(name: str) -> Column:
        return F.regexp_extract_all(body, F.lit(rf"(?s)(<(?:[\w-]+:)?{name}(?:\s[^>]*)?>.*?</(?:[\w-]+:)?{name}\s*>)"), F.lit(1))

    def entry(x: Column) -> Column:
        news = F.struct(_inner(x, "publication_date", "news:").alias("publication_date"), _inner(x, "title", "news:").alias("title"))
        return F.struct(*[_inner(x, n).alias(n) for n in ("loc", "lastmod", "priority", "changefreq")], news.alias("news"))

    def kept(x: Column) -> Column:
        found = F.coalesce(F.size(x["url"]), F.lit(-1)) + F.coalesce(F.size(x["sitemap"]), F.lit(-1)) > -2
        broken = F.struct(F.transform(parts("url"), entry).alias("url"), F.transform(parts("sitemap"), lambda s: F.struct(_inner(s, "loc").alias("loc"))).alias("sitemap"))
        return F.when(found, x).otherwise(broken)

    return let(F.from_xml(F.coalesce(body, F.lit("")), SITEMAP, {"ignoreNamespace": "true"}), kept)


def sub_sitemaps(bodies: DataFrame, most: int = 3) -> DataFrame:
    """feed_id, position, url of the child sitemaps of an index, the first ones."""
    found = F.filter(F.transform(_read_sitemap(F.col("body"))["sitemap"], lambda s: present(s["loc"])), lambda u: u.isNotNull())
    return bodies.select("feed_id", F.posexplode(F.slice(found, 1, most)).alias("position", "url"))


def sitemap(bodies: DataFrame, as_of: str, *, min_priority: float = 0.3, max_age_days: int = 30) -> DataFrame:
    """feed_id, body (a sitemap) to feed_id, position, url, title, published_at, priority, changefreq.

    Entries below the priority (0.5 if none is given), never changing, or older than the limit at as_of go; undated stay.
    """
    e = bodies.select("feed_id", F.posexplode(_read_sitemap(F.col("body"))["url"]).alias("position", "x"))
    given = present(F.col("x.priority"))
    number = F.coalesce(F.nullif(F.regexp_extract(given, r"^\s*([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.when(given.isNotNull(), F.lit(0.0)), F.lit(0.5))
    e = e.select(
        "feed_id",
        "position",
        present(F.col("x.loc")).alias("url"),
        present(F.col("x.news.title")).alias("title"),
        F.coalesce(present(F.col("x.news.publication_date")), present(F.col("x.lastmod"))).try_cast("timestamp").alias("published_at"),
        number.alias("priority"),
        F.lower(present(F.col("x.changefreq"))).alias("changefreq"),
    )
    fresh = F.col("published_at").isNull() | (F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {max_age_days} days"))
    return e.where(F.col("url").isNotNull() & (F.col("priority") >= min_priority) & (F.coalesce("changefreq", F.lit("")) != "never") & fresh)


def oembed(meta: DataFrame, payloads: DataFrame) -> DataFrame:
    """Meta articles (feed_id, title, description, author, image) with their payloads (feed_id, body) where stored.

    The payload's title, author and thumbnail win; its markup is the description only where the page has none.
    """
    p = payloads.select("feed_id", F.from_json("body", "title string, author_name string, thumbnail_url string, type string, url string, html string").alias("_o"))
    shot = F.coalesce(F.col("_o.thumbnail_url"), F.when(F.col("_o.type") == "photo", F.col("_o.url")))
    out = meta.join(p, "feed_id", "left")
    return out.withColumns(
        {
            "title": F.coalesce("_o.title", "title"),
            "description": F.coalesce("description", "_o.html"),
            "author": F.coalesce("_o.author_name", "author"),
            "image": F.coalesce(shot, F.col("image")),
        }
    ).drop("_o")
