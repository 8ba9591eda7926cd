"""Channel rows, status rows and the two renderings, RSS 2.0 and JSON Feed 1.1."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedweave.functions import dates, texts, urls

DEFAULT_TTL = 360


def channels(responses: DataFrame, overrides: dict | None = None, *, min_ttl: int = 0, as_of: str | None = None) -> DataFrame:
    """One channel row per response (feed_id, url, body, headers map)."""
    o = overrides or {}
    body, url = F.col("body"), F.col("url")

    def meta(name: str, key: str = "name") -> Column:
        tag = F.regexp_extract(body, rf'(?i)<meta[^>]*\b{key}=["\']{name}["\'][^>]*>', 0)
        found = F.regexp_extract(tag, r'(?i)\bcontent=["\']([^"\']*)["\']', 1)
        return F.when(found != "", unescape(found))

    title_raw = texts.collapse(unescape(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    title = F.coalesce(F.lit(o.get("title")), F.when(title_raw != "", title_raw), urls.channel_titleized(url))
    max_age = F.regexp_extract(F.coalesce(F.col("headers").getItem("cache-control"), F.lit("")), r"max-age=(\d+)", 1)
    ttl = F.coalesce(F.lit(o.get("ttl")).cast("int"), F.when(max_age != "", F.ceil(F.expr("try_cast(regexp_extract(coalesce(headers['cache-control'], ''), 'max-age=(\\\\d+)', 1) as bigint)") / 60)).cast("int"), F.lit(DEFAULT_TTL))
    head_lang = F.regexp_extract(F.coalesce(F.col("headers").getItem("content-language"), F.lit("")), "^([A-Za-z]{2})", 1)
    page_lang = F.regexp_extract(body, r'(?i)<[a-z][^>]*\blang=["\']([^"\']+)["\']', 1)
    stamp = F.try_to_timestamp(F.regexp_replace(F.col("headers").getItem("last-modified"), "^[A-Za-z]+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return responses.select(
        "feed_id",
        title.alias("title"),
        "url",
        F.coalesce(F.lit(o.get("description")), meta("description"), F.concat(F.lit("Latest items from "), url)).alias("description"),
        F.coalesce(F.lit(o.get("language")), F.when(head_lang != "", head_lang), F.when(page_lang != "", page_lang)).alias("language"),
        F.greatest(ttl, F.lit(min_ttl)).alias("ttl"),
        F.coalesce(stamp, F.lit(as_of).cast("timestamp")).alias("last_build_date"),
        F.coalesce(F.lit(o.get("image")), urls.sanitize(meta("og:image", "property"))).alias("image"),
        F.coalesce(F.lit(o.get("author")), meta("author")).alias("author"),
    )


def unescape(x: Column) -> Column:
    """The five named entities and the decimal quote."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def status(articles: DataFrame, drops: DataFrame | None = None, version: str = "0.1.0") -> DataFrame:
    """feed_id, version, scraper_tallies, admission_drops, generator: one row per feed."""
    from feedweave.operators.admission import tallies

    out = tallies(articles, "feed_id", "scraper").withColumnRenamed("tallies", "scraper_tallies")
    if drops is not None:
        out = out.join(tallies(drops, "feed_id", "reason").withColumnRenamed("tallies", "admission_drops"), "feed_id", "left")
    else:
        out = out.withColumn("admission_drops", F.lit(None).cast("map<string,bigint>"))
    listed = F.array_join(F.transform(F.map_entries("scraper_tallies"), lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(")"))), ", ")
    return out.withColumn("generator", F.concat(F.lit(f"feedweave {version} (scrapers: "), listed, F.lit(")"))).withColumn("version", F.lit(version))


def described(articles: DataFrame) -> Column:
    """An item's description: its media (else its image) before the text, which loses the title from its first half and is sanitized."""
    text, title = F.coalesce("description", F.lit("")), F.coalesce("title", F.lit(""))
    at = F.instr(text, title)
    early = (title != "") & (at > 0) & (at - 1 <= F.floor(F.length(text) / 2))
    text = F.when(early, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(title), F.length(text)))).otherwise(text)
    media = F.filter(F.transform("enclosures", lambda e: media_html(e, F.col("title"))), lambda m: m.isNotNull())
    picture = F.struct(F.col("image").alias("url"), F.lit("image/").alias("type"))
    media = F.when(F.size(media) > 0, media).when(F.col("image").isNotNull(), F.array(media_html(picture, F.col("title")))).otherwise(F.array().cast("array<string>"))
    whole = F.trim(F.array_join(F.concat(media, F.array(clean_html(text, F.col("url")))), "\n\n"))
    return F.when(whole != "", whole)


@F.pandas_udf(StringType())
def _cleaned(text: pd.Series, url: pd.Series) -> pd.Series:
    from feedweave.functions.postprocess import sanitize_html

    return pd.Series([sanitize_html(t, u or "") if t else None for t, u in zip(text, url, strict=True)], dtype=object)


def clean_html(text: Column, url: Column) -> Column:
    """Sanitized markup; null if nothing is left. Text without markup or entities does not leave the JVM."""
    plain = ~F.regexp_like(text, F.lit("[<&>]"))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n\t\r\x0b\f"))
    return F.when(plain, F.nullif(tidy, F.lit(""))).otherwise(_cleaned(F.when(~plain, text), url))


def published(articles_raw: Column, zone: str = "UTC") -> Column:
    """The earliest date among the lines of a raw date text, as a moment of functions.dates."""
    return dates.earliest(F.split(articles_raw, "\n"), zone)


def json_items(articles: DataFrame, zone: str = "UTC") -> DataFrame:
    """JSON Feed items: the composed description as HTML if it holds an element, else as text; else the title as text; items without either go."""
    articles = articles.withColumns({"_described": described(articles), "_time": dates.iso(published(F.col("published_at_raw"), zone))})
    content = F.coalesce("_described", "title")
    html = F.col("_described").isNotNull() & F.regexp_like(content, F.lit("<[a-zA-Z]"))
    attachments = F.transform("enclosures", lambda e: F.struct(e["url"].alias("url"), e["type"].alias("mime_type"), F.when(e["bytes_length"] > 0, e["bytes_length"]).alias("size_in_bytes")))
    item = F.struct(
        F.col("guid").alias("id"),
        F.col("url").alias("url"),
        F.col("title").alias("title"),
        F.when(html, content).alias("content_html"),
        F.when(~html, content).alias("content_text"),
        F.col("image").alias("image"),
        F.col("_time").alias("date_published"),
        F.when(F.col("author").isNotNull(), F.array(F.struct(F.col("author").alias("name")))).alias("authors"),
        F.when(F.size("categories") > 0, F.col("categories")).alias("tags"),
        F.when(F.size("enclosures") > 0, attachments).alias("attachments"),
    )
    return articles.where(content.isNotNull()).select("feed_id", "position", item.alias("item"))


def json_feed(articles: DataFrame, channel: DataFrame, zone: str = "UTC") -> DataFrame:
    """feed_id, json: the whole feed, items in order."""
    items = json_items(articles, zone).groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("items"))
    feed = F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"),
        F.col("title"),
        F.col("url").alias("home_page_url"),
        F.col("description"),
        F.col("language"),
        F.col("image").alias("icon"),
        F.when(F.col("author").isNotNull(), F.array(F.struct(F.col("author").alias("name")))).alias("authors"),
        F.transform(F.coalesce("items", F.array().cast(items.schema["items"].dataType)), lambda x: x["item"]).alias("items"),
    )
    return channel.join(items, "feed_id", "left").select("feed_id", F.to_json(feed).alias("json"))


def first_attachment(enclosures: Column) -> Column:
    """The first enclosure that is no image."""
    return F.get(F.filter(enclosures, lambda e: ~F.startswith(F.lower(e["type"]), F.lit("image/"))), F.lit(0))


def escaped(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def media_html(e: Column, title: Column) -> Column:
    """Markup of an enclosure by its kind; null for other kinds."""
    src, name = escaped(e["url"]), escaped(F.coalesce(title, F.lit("")))
    kind = F.lower(e["type"])
    return (
        F.when(F.startswith(kind, F.lit("image/")), F.concat(F.lit('<img src="'), src, F.lit('" alt="'), name, F.lit('" title="'), name, F.lit('" loading="lazy" referrerpolicy="no-referrer" decoding="async" crossorigin="anonymous">')))
        .when(F.startswith(kind, F.lit("video/")), F.concat(F.lit('<video controls preload="none" referrerpolicy="no-referrer" crossorigin="anonymous" playsinline><source src="'), src, F.lit('" type="'), escaped(e["type"]), F.lit('"></video>')))
        .when(F.startswith(kind, F.lit("audio/")), F.concat(F.lit('<audio controls preload="none" referrerpolicy="no-referrer" crossorigin="anonymous"><source src="'), src, F.lit('" type="'), escaped(e["type"]), F.lit('"></audio>')))
        .when(kind == "application/pdf", F.concat(F.lit('<iframe src="'), src, F.lit('" width="100%" height="75vh" sandbox="" referrerpolicy="no-referrer" loading="lazy"></iframe>')))
    )


def rss(articles: DataFrame, channel: DataFrame, stylesheets: tuple = (), zone: str = "UTC") -> DataFrame:
    """feed_id, xml. stylesheets: (href, type, media)."""
    articles = articles.withColumns({"description": described(articles), "_mail": dates.mail(published(F.col("published_at_raw"), zone))})
    items = articles.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("position", "title", "description", "author", "url", "_mail", "categories", first_attachment(F.col("enclosures")).alias("enclosure"), "guid"))).alias("items"))
    head = "".join(f'<?xml-stylesheet href="{escape(h)}" type="{escape(t)}" media="{escape(m)}"?>\n' for h, t, m in stylesheets)

    def tag(name: str, value: object, attrs: str = "") -> str:
        return f"<{name}{attrs}>{escape(str(value), quote=False)}</{name}>" if value not in (None, "") else ""

    def one(i: object) -> str:
        e = i["enclosure"]
        return "<item>" + "".join(
            [tag("title", i["title"]), tag("link", i["url"]), tag("description", i["description"]), tag("author", i["author"]), *[tag("category", c) for c in i["categories"]], f'<enclosure url="{escape(e["url"])}" length="{e["bytes_length"]}" type="{escape(e["type"])}"/>' if e else "", tag("guid", i["guid"], ' isPermaLink="false"'), tag("pubDate", i["_mail"])]
        ) + "</item>"

    def write(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                items_ = r["items"] if r["items"] is not None else []
                built = r["last_build_date"]
                out.append(
                    '<?xml version="1.0" encoding="UTF-8"?>\n' + head + '<rss version="2.0"><channel>'
                    + tag("title", r["title"]) + tag("link", r["url"]) + tag("description", r["description"]) + tag("language", r["language"]) + tag("managingEditor", r["author"]) + tag("ttl", r["ttl"])
                    + (tag("lastBuildDate", built.strftime("%a, %d %b %Y %H:%M:%S +0000")) if built is not None and not pd.isna(built) else "")
                    + "".join(map(one, items_)) + "</channel></rss>"
                )
            yield pd.DataFrame({"feed_id": pdf["feed_id"], "xml": out})

    return channel.join(items, "feed_id", "left").mapInPandas(write, "feed_id long, xml string")
