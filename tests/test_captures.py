"""Captures within a byte budget."""

import random

import pytest

from feedweave.sources import captures


def kept(rows, each, total):
    out, used = [], {}
    for g, at, body in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "")):
        n = len((body or "").encode())
        if 0 < n <= each and used.get(g, 0) + n <= total:
            used[g] = used.get(g, 0) + n
            out.append((g, at, body))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [4096, 3, 1])
def test_budget(spark, piece):
    rng = random.Random(piece)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice([None, "", "\u00e9" * rng.randint(1, 9), "x" * rng.randint(1, 14)])) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g long, at long, body string, _k int")
    got = captures.within_budget(df, "g", ["at"], "body", 12, 50, piece)
    assert got.columns == df.columns
    assert sorted([(r.g, r["at"], r.body) for r in got.collect()], key=str) == kept(rows, 12, 50)
    assert captures.within_budget(df.limit(0), "g", ["at"], "body", 12, 50, piece).count() == 0


def test_captures_of_pages(spark):
    ddl = "feed_id long, url string, captured array<struct<url:string,body:string,headers:map<string,string>,status_code:int>>"
    pages = spark.createDataFrame([(1, "https://a.example/", [(None, "[1]", None, 200), ("u", "x" * 500_001, {}, 200), ("v", "[2]", {"a": "b"}, None)]), (2, "https://b.example/", None)], ddl)
    assert [(r.feed_id, r.position, r.url, r.body) for r in captures.captures(pages).orderBy("position").collect()] == [(1, 0, "", "[1]"), (1, 2, "v", "[2]")]
