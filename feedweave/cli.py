"""Command line: feeds, automatic feeds and inferred selectors of stored pages; validation; the configuration's schema."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import admission, auto, feeds, selectors
from feedweave.plans import config as plans
from feedweave.sources.responses import local_files, responses


def stored(spark: SparkSession, path: str, url: str) -> DataFrame:
    """Pages of files, with a headers column for the channel; rows in error are left out."""
    got = responses(local_files(spark, path, url)).where("error is null")
    return got.withColumn("headers", F.create_map().cast("map<string,string>"))


def rendered(articles: DataFrame, pages: DataFrame, channel: dict, kind: str, stylesheets: list | None = None) -> DataFrame:
    head = feeds.channels(pages, {k: v for k, v in channel.items() if k not in ("url", "time_zone")})
    sheets = tuple((s["href"], s["type"], s.get("media") or "all") for s in stylesheets or [])
    return feeds.rss(articles, head, sheets) if kind == "rss" else feeds.json_feed(articles, head)


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(r[1])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("feedweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("feed", "validate"):
        c = commands.add_parser(name)
        c.add_argument("config")
        c.add_argument("feed", nargs="?")
        c.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
        if name == "feed":
            c.add_argument("--pages", help="stored pages; request.local_file_path is the default")
            c.add_argument("--format", choices=("rss", "json"), default="rss")
    for name in ("auto", "capture"):
        c = commands.add_parser(name)
        c.add_argument("pages")
        c.add_argument("--url", required=True)
        if name == "auto":
            c.add_argument("--limit", type=int, default=25)
            c.add_argument("--format", choices=("rss", "json"), default="rss")
    commands.add_parser("schema")
    args = parser.parse_args(argv)

    if args.command == "schema":
        print(json.dumps(plans.json_schema(), indent=2))
        return 0
    if args.command in ("feed", "validate"):
        with open(args.config, encoding="utf-8") as f:
            given = plans.from_yaml(f.read(), args.feed)
        wrong = plans.problems(given)
        for path, message in wrong:
            print(f"{path or 'configuration'} {message}", file=sys.stderr)
        if wrong or args.command == "validate":
            return 1 if wrong else 0
        conf = plans.prepared(given, dict(p.split("=", 1) for p in args.param))
        channel, path = conf["channel"], args.pages or conf["request"].get("local_file_path")
        if not path:
            print("pages are read from storage: give --pages or request.local_file_path", file=sys.stderr)
            return 1
    else:
        conf, channel, path = {"auto_source": {"limit": getattr(args, "limit", 25)}}, {"url": args.url}, args.pages

    spark = spark or SparkSession.builder.appName("feedweave").getOrCreate()
    pages = stored(spark, path, channel["url"])
    parts = []
    if conf.get("selectors"):
        parts.append(selectors.query(pages, conf).where("error is null"))
    if conf.get("auto_source") is not None:
        parts.append(auto.auto_source(pages, conf["auto_source"]))
    articles = parts[0]
    if len(parts) > 1:  # the selectors' articles first
        articles = articles.unionByName(parts[1].withColumn("position", F.col("position") + 1_000_000))
    articles = admission.dedup(articles)
    if args.command == "capture":
        for r in auto.capture(pages, articles).toLocalIterator():
            print(plans.to_yaml({"channel": {"url": args.url, "time_zone": "UTC"}, "selectors": {"items": {"selector": r["selector"], "enhance": True}}}))
    else:
        _show(rendered(articles, pages, channel, args.format, conf.get("stylesheets")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
