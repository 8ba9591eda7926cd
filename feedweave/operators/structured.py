"""Articles that pages state as data: JSON-LD, microdata, microformats, script state, captured JSON bodies, meta tags.

One Arrow pass parses a page once and runs the readers asked for; a reader maps a document tree or a JSON value to field
dicts, which become article rows like those of the selector query. Depth has no bound: the walks keep their own stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from feedweave.dom import css
from feedweave.dom.tree import Node, parse
from feedweave.functions.urls import normalized, resolved
from feedweave.operators.selectors import ARTICLE, ARTICLE_DDL, row

# Article and container types, property names by priority, state variables, meta names.
ARTICLE_TYPES = frozenset(
    "AdvertiserContentArticle AnalysisNewsArticle APIReference Article AskPublicNewsArticle BackgroundNewsArticle BlogPosting "
    "DiscussionForumPosting LiveBlogPosting NewsArticle OpinionNewsArticle Report ReportageNewsArticle ReviewNewsArticle "
    "SatiricalArticle ScholarlyArticle SocialMediaPosting TechArticle".split()
)
COLLECTIONS = ("itemListElement", "blogPost", "mainEntity", "hasPart")
VALUE_ATTRIBUTES = ("content", "datetime", "href", "src", "data", "value")
TITLE_KEYS = ("title", "headline", "name", "text")
URL_KEYS = ("url", "link", "href", "permalink", "slug", "path", "canonicalUrl", "shortUrl")
DESCRIPTION_KEYS = ("description", "summary", "excerpt", "dek", "subheading")
IMAGE_KEYS = ("image", "imageUrl", "thumbnailUrl", "thumbnail", "src", "featuredImage", "coverImage", "heroImage")
PUBLISHED_KEYS = ("published_at", "publishedAt", "datePublished", "date", "publicationDate", "pubDate", "updatedAt", "updated_at", "createdAt", "created_at")
CATEGORY_KEYS = ("categories", "tags", "section", "sections", "topic", "topics", "channel")
ID_KEYS = ("id", "guid", "uuid", "slug", "key")
STATE_VARIABLES = ("__NEXT_DATA__", "__NUXT__", "STATE", "__REDUX_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__remixContext", "__sveltekit_data", "GATSBY_STATE", "__ember_meta", "angular")
META_FIELDS = {
    "og:title": "title",
    "twitter:title": "title",
    "og:url": "url",
    "og:description": "description",
    "twitter:description": "description",
    "og:image": "image",
    "twitter:image": "image",
    "article:published_time": "published_at",
    "article:author": "author",
}

_ASSIGNED = re.compile(r"(?:window|self|globalThis)\.(?:" + "|".join(STATE_VARIABLES) + r")\s*=\s*")
_BARE_KEY = re.compile(r"(^\s*|[{,\[]\s*)([A-Za-z_]\w*)(\s*:)")
_LAST_COMMA = re.compile(r",(\s*[\]}])")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)


def scalar(value: object) -> str | None:
    """A JSON scalar as stripped text; null, blank and containers have none."""
    if value is None or isinstance(value, (dict, list)):
        return None
    out = json.dumps(value) if isinstance(value, (bool, int, float)) else str(value).strip()
    return out or None


def loaded(text: str) -> object:
    """A JSON value or None."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


# --- schema objects


def type_names(value: object) -> set[str]:
    """Short type names of an @type value, text or lists of it."""
    todo, out = [value], set()
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x
        elif isinstance(x, str):
            out.add(re.sub(r"(?i)^https?://schema\.org/", "", x))
    return out - {""}


def things(value: object) -> Iterator[dict]:
    """Article objects anywhere in a JSON-LD value, collection properties first; an emitted object is not entered."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            kinds = type_names(x.get("@type"))
            if "ItemList" in kinds:
                yield from listed(x.get("itemListElement"))
            elif kinds & ARTICLE_TYPES:
                yield x
            else:
                first = [x[k] for k in COLLECTIONS if k in x]
                todo += reversed(first + [v for k, v in x.items() if k not in COLLECTIONS])


def listed(elements: object) -> Iterator[dict]:
    """Members of an item list: what a ListItem holds (or itself), else elements of an article type."""
    for e in elements if isinstance(elements, list) else [elements]:
        if isinstance(e, dict):
            kinds = type_names(e.get("@type"))
            if "ListItem" in kinds:
                yield e["item"] if isinstance(e.get("item"), dict) else e
            elif kinds & ARTICLE_TYPES:
                yield e


def person(value: object) -> str | None:
    """A name, the name of an object, or names joined."""
    if isinstance(value, list):
        return ", ".join(n for n in map(person, value) if n) or None
    return scalar(value.get("name")) if isinstance(value, dict) else value.strip() or None if isinstance(value, str) else None


def picture(value: object) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict) and "ImageObject" in type_names(value.get("@type")):
        return scalar(value.get("url")) or scalar(value.get("contentUrl"))
    return None


def labels(o: dict) -> list[str]:
    """Categories: lists as they are, texts split at comma, semicolon and bar, the subject by its name."""
    out: list[str] = []
    for value in (o.get("articleSection"), o.get("keywords"), o.get("categories"), o.get("tags"), o.get("about")):
        if isinstance(value, str):
            out += [p.strip() for p in re.split("[,;|]", value)]
        elif isinstance(value, list):
            out += [scalar(v.get("name")) if isinstance(v, dict) else scalar(v) for v in value]
    return list(dict.fromkeys(x for x in out if x))


def stable_id(given: str | None, url: str | None, base: str) -> str | None:
    """Same host: the path, or path and query at the root; other ids as they are; without one, the URL's path."""
    if not given:
        return (urlsplit(url).path or None) if url else None
    try:
        full = resolved(given, url or base) if given.startswith("/") else normalized(given)
        here, there = urlsplit(full or ""), urlsplit(url or base)
    except ValueError:
        return given
    if not here.hostname or here.hostname != there.hostname:
        return given
    return f"{here.path}?{here.query}" if here.path in ("", "/") and here.query else here.path or here.query


def thing(o: dict, base: str) -> dict:
    """Article fields of a schema object."""
    raw = scalar(o.get("url"))
    url = resolved(raw, base) if raw else None
    image = next((p for p in (picture(o.get("image")), picture(o.get("thumbnailUrl"))) if p), None)
    texts = [t for t in (o.get(k) for k in ("description", "articleBody", "abstract", "schema_object_body")) if isinstance(t, str)]
    return {
        "id": stable_id(scalar(o.get("@id")), url, base),
        "title": next((t for t in (scalar(o.get(k)) for k in ("headline", "name", "alternativeHeadline", "title")) if t), None),
        "description": max(texts, key=len, default=None),
        "author": person(o.get("author")) or person(o.get("publisher")),
        "url": url,
        "image": resolved(image, base) if image else None,
        "published_at": scalar(o.get("datePublished")) or scalar(o.get("dateModified")),
        "categories": labels(o),
    }


def json_ld(doc: Node, base: str) -> Iterator[dict]:
    for script in css.select(doc, 'script[type="application/ld+json"]'):
        for o in things(loaded(script.text())):
            yield thing(o, base)


# --- microdata


def _item_types(n: Node) -> list[str]:
    return [t for t in (re.split("[/#]", v)[-1] for v in n.attrs.get("itemtype", "").split()) if t]


def properties(item: Node) -> dict[str, list]:
    """Values by property name; nested items belong to their own scope, and become dicts."""
    out: dict[str, list] = {}
    todo = list(reversed(item.elements()))
    while todo:
        n = todo.pop()
        inner = "itemscope" in n.attrs
        if "itemprop" in n.attrs:
            if inner:
                value: object = {k: v[0] for k, v in properties(n).items()} | {"@type": (_item_types(n) or [None])[0], "@id": n.attrs.get("itemid")}
            else:
                value = next((n.attrs[a] for a in VALUE_ATTRIBUTES if n.attrs.get(a, "").strip()), None) or n.text().strip()
            if value:
                for name in n.attrs["itemprop"].split():
                    out.setdefault(name, []).append(value)
        if not inner:
            todo += reversed(n.elements())
    return out


def microdata(doc: Node, base: str) -> Iterator[dict]:
    """Top-level items of an article type or Product, with a URL and a title or description."""
    for n in css.select(doc, "[itemscope][itemtype]"):
        nested = "itemprop" in n.attrs or any("itemscope" in a.attrs and "itemprop" in a.attrs for a in n.ancestors())
        kind = next((t for t in _item_types(n) if t in ARTICLE_TYPES or t == "Product"), None)
        if nested or kind is None:
            continue
        p = properties(n)

        def one(*names: str, p: dict = p) -> str | None:
            return next((v for v in (scalar(p[k][0]) for k in names if k in p) if v), None)

        def link(name: str, p: dict = p) -> str | None:
            v = p[name][0] if name in p else None
            return scalar(v.get("url")) or scalar(v.get("@id")) if isinstance(v, dict) else scalar(v)

        ident = scalar(n.attrs.get("itemid")) or one("identifier")
        o = {
            "@type": kind,
            "@id": ident,
            "title": one("headline", "title", "name"),
            "description": one("description"),
            "articleBody": one("articleBody"),
            "abstract": one("abstract"),
            "datePublished": one("datePublished", "dateCreated", "dateModified", "uploadDate"),
            "url": link("url") or link("mainEntityOfPage") or (ident if ident and re.match("/|https?://", ident) else None),
            "image": next((p[k][0] for k in ("image", "thumbnailUrl") if k in p), None),
            "categories": [s for k in ("categories", "articleSection") for s in map(scalar, p.get(k, [])[:1]) if s],
            "keywords": one("keywords"),
            "tags": one("tags"),
            "about": p.get("about", [])[:1],
        }
        got = thing(o, base)
        if got["url"] and (got["title"] or got["description"]):
            yield got


# --- microformats


def microformats(doc: Node, base: str) -> Iterator[dict]:
    """h-entry elements with a title or a link; the page's URL stands in for a missing link."""

    def first(item: Node, selector: str) -> Node | None:
        return next(iter(css.select(item, selector)), None)

    def text(n: Node | None) -> str | None:
        return n.text().strip() or None if n else None

    for item in css.select(doc, '[class*="h-entry"]'):
        title, anchor = text(first(item, ".p-name")), first(item, ".u-url")
        href = anchor.attrs.get("href", "").strip() if anchor else ""
        url = resolved(href, base) if href else None
        if not title and not url:
            continue
        content = first(item, ".e-content, .p-summary")
        photo = first(item, ".u-featured, .u-photo")
        source = (photo.attrs.get("src") or photo.attrs.get("href") or "").strip() if photo else ""
        when = first(item, ".dt-published")
        yield {
            "title": title,
            "url": url or base,
            "description": "".join(c.html() if isinstance(c, Node) else c for c in content.children).strip() or None if content else None,
            "image": resolved(source, base) if source else None,
            "author": text(first(item, ".p-author .p-name, .p-author, .h-card .p-name")),
            "published_at": (when.attrs.get("datetime", "").strip() or text(when)) if when else None,
            "categories": [c for c in map(text, css.select(item, ".p-category")) if c],
        }


# --- script state and captured JSON


def find(value: object, keys: tuple) -> object:
    """The first of keys that an object has, be its value null; else in its attributes, then data; lists: the first hit."""
    if isinstance(value, list):
        return next((hit for hit in (find(v, keys) for v in value) if hit not in (None, False)), None)
    if not isinstance(value, dict):
        return None
    present = next((k for k in keys if k in value), None)
    if present is not None:
        return value[present]
    hit = find(value.get("attributes"), keys)
    return hit if hit not in (None, False) else find(value.get("data"), keys)


def block(text: str) -> str:
    """The first balanced object or array in text; text itself without one."""
    opened: list[int] = []
    for m in _TOKEN.finditer(text, min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=len(text))):
        t = m.group()
        if t in "{[":
            opened.append(m.start())
        elif t in "}]" and opened:
            start = opened.pop()
            if not opened:
                return text[start : m.end()] if text[start] + t in ("{}", "[]") else text
    return text


def js_value(text: str) -> object:
    """JSON, or an object literal with bare keys and trailing commas."""
    got = loaded(text)
    return got if got is not None else loaded(_LAST_COMMA.sub(r"\1", _BARE_KEY.sub(r'\1"\2"\3', text)))


def entry(e: object, base: str) -> dict | None:
    """Article fields of a state object: a URL, and a title or description."""
    if not isinstance(e, dict):
        return None

    def at(keys: tuple) -> str | None:
        v = find(e, keys)
        return scalar(find(v, keys) if isinstance(v, dict) else v)

    raw, image = at(URL_KEYS), at(IMAGE_KEYS)
    url = resolved(raw, base) if raw else None
    title, description = scalar(find(e, TITLE_KEYS)), scalar(find(e, DESCRIPTION_KEYS))
    if not url or (title is None and description is None):
        return None
    groups = find(e, CATEGORY_KEYS)
    groups = list(groups.values()) if isinstance(groups, dict) else groups if isinstance(groups, list) else [groups]
    names = [scalar(find(g, ("name", "title", "label"))) if isinstance(g, dict) else scalar(g) for g in groups]
    return {
        "id": at(ID_KEYS) or url,
        "title": title,
        "description": description,
        "url": url,
        "image": resolved(image, base) if image else None,
        "published_at": scalar(find(e, PUBLISHED_KEYS)),
        "categories": list(dict.fromkeys(n for n in names if n)),
    }


def entries(value: object, base: str) -> Iterator[dict]:
    """Articles of every list in which some object has a title and a URL; such lists are not entered further."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            if any(isinstance(e, dict) and find(e, TITLE_KEYS) not in (None, False) and find(e, URL_KEYS) not in (None, False) for e in x):
                yield from (a for a in (entry(e, base) for e in x) if a)
            else:
                todo += reversed(x)


def json_state(doc: Node, base: str) -> Iterator[dict]:
    """Typed JSON scripts first, then the assignments to known state variables."""
    for script in css.select(doc, 'script[type="application/json"]'):
        yield from entries(js_value(script.text()), base)
    for script in css.select(doc, "script"):
        source = script.text().strip()
        m = _ASSIGNED.search(source)
        if m:
            yield from entries(js_value(block(source[: m.start()] + source[m.end() :])), base)


# --- meta tags


def meta_tags(doc: Node, base: str) -> Iterator[dict]:
    """One article from the first value of each meta field; the page's URL unless one is given."""
    got: dict[str, str] = {}
    for n in css.select(doc, 'meta[property^="og:"], meta[property^="article:"], meta[name^="twitter:"]'):
        field = META_FIELDS.get(n.attrs.get("property") or n.attrs.get("name", ""))
        if field and n.attrs.get("content"):
            got.setdefault(field, n.attrs["content"])
    if "title" in got:
        yield got | {"url": resolved(got["url"], base) if "url" in got else base, "image": resolved(got["image"], base) if "image" in got else None}


#: Readers in tier order.
READERS: dict[str, Callable[[Node, str], Iterator[dict]]] = {"schema": json_ld, "microdata": microdata, "microformats2": microformats, "json_state": json_state, "meta_oembed": meta_tags}


def _emit(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARTICLE, strict=True)], schema=ARTICLE)


def scrape(responses: DataFrame, readers: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """responses (feed_id long, url, body) to article rows; position counts per page and reader. A null body has none."""
    chosen = {name: READERS[name] for name in readers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for feed, url, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if body is None:
                    continue
                doc = parse(body)
                for name, reader in chosen.items():
                    out += [row(feed, i, a, scraper=name) for i, a in enumerate(reader(doc, url or ""))]
            if out:
                yield _emit(out)

    return responses.select("feed_id", "url", "body").mapInArrow(run, ARTICLE_DDL)


def captured(bodies: DataFrame) -> DataFrame:
    """Captured JSON responses (feed_id long, url, body: the page's URL, one row per body) to article rows, as script state is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for feed, url, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out += [row(feed, i, a, scraper="xhr_articles") for i, a in enumerate(entries(loaded(body or ""), url or ""))]
            if out:
                yield _emit(out)

    return bodies.select("feed_id", "url", "body").mapInArrow(run, ARTICLE_DDL)
