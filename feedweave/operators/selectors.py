"""The selector query: items by CSS, fields by extractor and steps, missing fields filled by the extraction rules.

Each response is parsed once, inside one Arrow pass; everything after (dedup, ranking, rendering) is relational. Row
errors do not stop a feed: they come back in the column error.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from feedweave.dom import css
from feedweave.dom.text import collapse, visible_text
from feedweave.dom.tree import Node, lift, parse
from feedweave.functions import postprocess
from feedweave.functions.urls import resolved
from feedweave.operators.extract import base36, enclosure, extract, main_anchor

FIELDS = ("id", "title", "description", "url", "image", "author", "published_at", "guid", "enclosure", "categories")
ENCLOSURE = pa.struct([("url", pa.string()), ("type", pa.string()), ("bytes_length", pa.int64())])
ARTICLE = pa.schema(
    [("feed_id", pa.int64()), ("position", pa.int32()), ("id", pa.string()), ("title", pa.string()), ("description", pa.string()), ("url", pa.string()), ("image", pa.string()), ("author", pa.string()), ("guid", pa.string()), ("published_at_raw", pa.string()), ("enclosures", pa.list_(ENCLOSURE)), ("categories", pa.list_(pa.string())), ("scraper", pa.string()), ("error", pa.string())]
)
ARTICLE_DDL = (
    "feed_id long, position int, id string, title string, description string, url string, image string, author string, guid string, published_at_raw string, "
    "enclosures array<struct<url:string,type:string,bytes_length:bigint>>, categories array<string>, scraper string, error string"
)


class Scope:
    """One item: its fields by name, evaluated once, in the order they are asked for."""

    def __init__(self, item: Node, selectors: dict, base: str, time_zone: str) -> None:
        self.item, self.selectors, self.base, self.time_zone = item, selectors, base, time_zone
        self.known: dict[str, object] = {}

    def field(self, name: str) -> object:
        if name not in self.known:
            if name not in self.selectors or name == "items":
                raise KeyError(f"undefined selector {name!r}")
            self.known[name] = self.value(self.selectors[name])
        return self.known[name]

    def nodes(self, config: dict) -> list[Node]:
        selector = config.get("selector")
        return [self.item] if not selector else css.select(self.item, selector)

    def value(self, config: dict) -> object:
        nodes = self.nodes(config)
        kind = config.get("extractor", "text")
        if kind == "static":
            out = config.get("static")
        elif kind == "text":
            out = collapse("".join(n.text() for n in nodes))
        elif kind == "html":
            out = "".join(n.html() for n in nodes)
        elif kind == "attribute":
            out = nodes[0].attrs.get(config["attribute"], "") if nodes else ""
        else:
            out = resolved(nodes[0].attrs.get("href", "") if nodes else "", self.base)
        steps = config.get("post_process") or []
        for step in [steps] if isinstance(steps, dict) else steps:
            if out is None or out is False:
                break
            out = postprocess.apply_step(out, step, self)
        return out

    def category(self, name: str) -> list[str]:
        config = self.selectors[name]
        nodes = self.nodes(config)
        if len(nodes) <= 1:
            values = [self.field(name)]
        else:
            values = [Scope(n, self.selectors, self.base, self.time_zone).value({**config, "selector": None}) for n in nodes]
        return [str(v).strip() for v in values if v is not None and str(v).strip()]


def article(item: Node, selectors: dict, base: str, time_zone: str = "UTC") -> dict:
    """One result row. An empty text from a selector counts as given; only absent fields are filled."""
    scope = Scope(item, selectors, base, time_zone)
    out: dict[str, object] = {}
    for name in FIELDS:
        config = selectors.get(name)
        if config is None:
            continue
        if name == "categories":
            out[name] = list(dict.fromkeys(c for ref in config for c in scope.category(ref)))
        elif name == "guid":
            out[name] = [scope.field(ref) for ref in config] if isinstance(config, list) else scope.field(name)
        elif name == "enclosure":
            url = scope.field(name)
            if url and str(url).strip():
                out["enclosures"] = [enclosure(resolved(str(url), base) or str(url), config.get("content_type"))]
        else:
            value = scope.field(name)
            if value is not None:
                out[name] = value
    if selectors.get("items", {}).get("enhance", True):
        for k, v in extract(item, base, main_anchor(item)).items():
            if out.get(k) is None:
                out[k] = v
    return out


def _blank(x: object) -> str | None:
    return None if x is None or not str(x).strip() else str(x)


def row(feed_id: object, position: int, a: dict, scraper: str = "selectors", error: str | None = None) -> tuple:
    url = _blank(a.get("url"))
    ident = _blank(a.get("id"))
    given = a.get("guid")
    source = "".join(s for s in (str(x or "").strip() for x in given) if s) if isinstance(given, list) else "#!/".join((url or "", ident or ""))
    return (
        feed_id, position, ident, _blank(a.get("title")), _blank(a.get("description")), url, _blank(a.get("image")), _blank(a.get("author")),
        base36(zlib.crc32(source.encode())), _blank(a.get("published_at")), a.get("enclosures") or [], list(dict.fromkeys(c.strip() for c in a.get("categories") or [] if c.strip())), scraper, error,
    )


def document(body: str, content_type: str | None) -> Node:
    if content_type and "json" in content_type and not body.lstrip()[:1] == "<":
        return lift(json.loads(body))
    return parse(body)


def query(responses: DataFrame, config: dict) -> DataFrame:
    """responses (feed_id long, url, body, content_type) to article rows under config (channel, selectors)."""
    selectors = config["selectors"]
    css.compile_selector(selectors["items"]["selector"])
    for name, c in selectors.items():
        if isinstance(c, dict) and c.get("selector"):
            css.compile_selector(c["selector"])
        steps = c.get("post_process") or [] if isinstance(c, dict) else []
        for step in [steps] if isinstance(steps, dict) else steps:
            postprocess.check_step(step)
        if name in ("guid", "categories"):
            missing = [r for r in c if r not in selectors]
            if missing:
                raise ValueError(f"{name} refers to undefined selectors {missing}")
    zone = config.get("channel", {}).get("time_zone", "UTC")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for feed, url, body, kind in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if body is None:
                    continue
                try:
                    items = css.select(document(body, kind), selectors["items"]["selector"])
                except (ValueError, RecursionError) as e:
                    out.append(row(feed, 0, {}, error=f"{type(e).__name__}: {e}"))
                    continue
                if selectors["items"].get("order") == "reverse":
                    items.reverse()
                for i, item in enumerate(items):
                    try:
                        out.append(row(feed, i, article(item, selectors, url or "", zone)))
                    except (ValueError, TypeError, KeyError) as e:
                        out.append(row(feed, i, {}, error=f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARTICLE, strict=True)], schema=ARTICLE)

    return responses.select("feed_id", "url", "body", "content_type").mapInArrow(run, ARTICLE_DDL)


def label(n: Node) -> str:
    return visible_text(n) or ""
