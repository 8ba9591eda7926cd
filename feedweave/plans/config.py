"""Feed configurations: reading, defaults, merging, parameters, headers, validation, JSON schema and request budget.

A configuration is a small dict on the driver. Many of them are validated as a table of errors (problems_frame).
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from feedweave.functions import postprocess
from feedweave.operators.policy import MAX_REQUESTS_CEILING

#: Fixed values of the configuration language.
SCRAPERS = ("wordpress_api", "schema", "microdata", "microformats2", "json_state", "xhr_articles", "sitemap", "meta_oembed", "semantic_html", "html")
EXTRACTORS = {"attribute": ("attribute",), "href": (), "html": (), "static": ("static",), "text": ()}
PAGERS = ("rel_next", "custom_selector", "url_template", "offset", "json_cursor")
STRATEGIES = ("auto", "faraday", "botasaurus", "local_file")
FALLBACK_CHAIN = ("faraday", "botasaurus")
TOPICS = ("sports", "energy", "tech", "science", "news", "entertainment", "jobs", "finance", "security", "travel", "environment", "consumer", "civic", "product", "research")
STYLESHEET_TYPES = ("text/css", "text/xsl")
LANGUAGE = re.compile(r"[a-z]{2}(-[A-Z]{2})?")
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,image/apng,*/*;q=0.8"
HEADERS = {
    "Accept": ACCEPT, "Cache-Control": "max-age=0", "Connection": "keep-alive", "Sec-Fetch-Dest": "document", "Sec-Fetch-Mode": "navigate",
    "Sec-Fetch-Site": "none", "Sec-Fetch-User": "?1", "Upgrade-Insecure-Requests": "1", "User-Agent": "feedweave/0.1.0",
}
REQUEST_SLOTS = {"wordpress_api": 1, "sitemap": 4}
DEFAULT_PAGES = 5

DEFAULTS: dict = {
    "strategy": "auto",
    "channel": {"time_zone": "UTC"},
    "request": {"max_redirects": 5, "max_requests": 1, "total_timeout_seconds": 30},
}
AUTO_DEFAULTS: dict = {
    "limit": 25,
    "scraper": {name: {"enabled": True} for name in SCRAPERS}
    | {
        "sitemap": {"enabled": True, "min_priority": 0.3, "max_age_days": 30},
        "semantic_html": {"enabled": True, "fallback_anchorless": True},
        "html": {"enabled": True, "minimum_selector_frequency": 2, "use_top_selectors": 5, "fallback_anchorless": True},
    },
    "cleanup": {"keep_different_domain": False},
}


class ParamsMissing(KeyError):
    """A text names a parameter that was not given."""


def merged(base: dict, over: dict) -> dict:
    """Deep merge: dicts by key, else the second wins. Neither argument changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def feed_of(document: dict, name: str | None = None) -> dict:
    """One feed of a document: the document itself, or the named entry of feeds, to which the other top keys are global."""
    if "feeds" not in document:
        return document
    if name not in document["feeds"]:
        raise KeyError(f"feed {name!r} is not among {sorted(document['feeds'])}")
    out = copy.deepcopy(document["feeds"][name])
    for k, v in document.items():
        if k == "feeds":
            continue
        mine = out.get(k)
        if isinstance(v, dict) and isinstance(mine, dict):
            out[k] = merged(v, mine)
        elif isinstance(v, list) and isinstance(mine, list):
            out[k] = mine + copy.deepcopy(v)
        elif mine is None:
            out[k] = copy.deepcopy(v)
    return out


def from_yaml(text: str, name: str | None = None) -> dict:
    import yaml

    document = yaml.safe_load(text)
    if not isinstance(document, dict):
        raise ValueError("a configuration is a mapping")
    return feed_of(document, name)


def to_yaml(config: dict) -> str:
    import yaml

    return yaml.safe_dump(config, sort_keys=False, allow_unicode=True)


_SLOT = re.compile(r"%\{([^{}]*)\}|%<([^<>]*)>s")


def with_params(value: object, params: dict, missing: str | None = None) -> object:
    """%{name} and %<name>s in all texts; a name without value gives missing, or ParamsMissing if there is none."""
    if isinstance(value, dict):
        return {k: with_params(v, params, missing) for k, v in value.items()}
    if isinstance(value, list):
        return [with_params(v, params, missing) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        got = params.get(m[1] if m[1] is not None else m[2], missing)
        if got is None:
            raise ParamsMissing(m[0])
        return str(got)

    return _SLOT.sub(put, value)


def headers(given: dict | None, language: str | None = None, url: str | None = None) -> dict[str, str]:
    """Request headers: defaults, then given ones under their usual spelling; accepted types of both, given ones first."""
    own = {"-".join(p.capitalize() for p in str(k).split("-")): v for k, v in (given or {}).items()}
    types = ACCEPT.split(",")
    asked = [t.strip() for t in (own.pop("Accept", None) or "").split(",") if t.strip()]
    out = HEADERS | own
    out["Accept"] = ",".join([*dict.fromkeys(t for t in asked if t not in types), *types])
    primary, _, region = (language or "").strip().replace("_", "-").partition("-")
    primary, region = primary.lower(), region.upper()
    out["Accept-Language"] = f"{primary}-{region},{primary};q=0.9" if region else primary or "en-US,en;q=0.9"
    host = re.match(r"[a-z]+://([^/?#:]+)", url or "", re.I)
    if host:
        out.setdefault("Host", host[1].lower())
    return {k: v for k, v in out.items() if v is not None}


def prepared(config: dict, params: dict | None = None, missing: str | None = None) -> dict:
    """Defaults filled, parameters put into headers and channel, headers completed."""
    out = merged(DEFAULTS, config)
    if config.get("auto_source") is not None:
        out["auto_source"] = merged(AUTO_DEFAULTS, config["auto_source"])
    values = {k: v.get("default") for k, v in (config.get("parameters") or {}).items() if isinstance(v, dict)} | (params or {})
    for key in ("headers", "channel"):
        if out.get(key):
            out[key] = with_params(out[key], values, missing)
    out["headers"] = headers(out.get("headers"), out["channel"].get("language"), out["channel"].get("url"))
    return out


def page_slots(pagination: object) -> int:
    """Follow-up pages a pagination may take."""
    if not pagination:
        return 0
    pages = pagination if isinstance(pagination, int) else pagination.get("max_pages", DEFAULT_PAGES)
    return max(0, pages - 1)


def request_budget(config: dict) -> int:
    """Requests a feed may use: as given, else one for the page and one for each follow-up its parts may need."""
    given = (config.get("request") or {}).get("max_requests")
    if given is not None:
        return min(given, MAX_REQUESTS_CEILING)
    selectors, auto = config.get("selectors") or {}, config.get("auto_source")
    scrapers = merged(AUTO_DEFAULTS, auto)["scraper"] if auto is not None else {}
    extra = sum(n for name, n in REQUEST_SLOTS.items() if scrapers.get(name, {}).get("enabled"))
    fallback = len(strategy_plan(config.get("strategy", "auto"))) - 1
    return min(1 + page_slots((selectors.get("items") or {}).get("pagination")) + extra + fallback, MAX_REQUESTS_CEILING)


def strategy_plan(name: str) -> tuple[str, ...]:
    """Transports to try in order: the chain for auto, else the named one. An unknown name is an error."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of: {', '.join(STRATEGIES)}")
    return FALLBACK_CHAIN if name == "auto" else (name,)


def valid_strategy(name: object) -> bool:
    return isinstance(name, str) and name in STRATEGIES


def diagnostic_strategy(name: str | None = None) -> str:
    """The transport of a single request: the chain's first for auto."""
    return strategy_plan(name or "auto")[0]


# --- validation


def _absolute(url: object) -> bool:
    return isinstance(url, str) and bool(re.match(r"https?://[^/?#\s]+", url, re.I)) and not re.match(r"[a-z]+://[^/?#]*@", url, re.I) and "@" not in re.sub(r"^[^?#]*", "", url)


def _natural(x: object, least: int = 1) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _text(x: object) -> bool:
    return isinstance(x, str) and x != ""


def _pagination(p: object) -> Iterator[str]:
    if isinstance(p, bool) or not isinstance(p, (int, dict)):
        yield "must be an integer or a mapping"
    elif isinstance(p, int):
        if p < 1:
            yield "must be greater than 0"
    else:
        if "max_pages" in p and not _natural(p["max_pages"]):
            yield "max_pages must be an integer greater than 0"
        kind = p.get("strategy", "rel_next")
        if kind not in PAGERS:
            yield f"strategy must be one of: {', '.join(PAGERS)}"
        if kind == "custom_selector" and not str(p.get("selector") or "").strip():
            yield "custom_selector needs a selector"
        if kind == "json_cursor" and not any(str(p.get(k) or "").strip() for k in ("cursor_path", "next_url_path")):
            yield "json_cursor needs cursor_path or next_url_path"


def _selector(c: object, enclosure: bool) -> Iterator[tuple[str, str]]:
    if not isinstance(c, dict):
        yield "", "must be a mapping"
        return
    if c.get("selector") is not None and not isinstance(c["selector"], str):
        yield "selector", "must be a string"
    kind = c.get("extractor")
    if kind is not None and kind not in EXTRACTORS:
        yield "extractor", f"unknown extractor: {kind}"
    for field in EXTRACTORS.get(kind, ()):
        if not c.get(field):
            yield field, f"is required for extractor {kind}"
    steps = c.get("post_process") or []
    for step in [steps] if isinstance(steps, dict) else steps:
        try:
            postprocess.check_step(step)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield "post_process", str(e)
    if enclosure and c.get("content_type") is not None and not re.fullmatch(r"[\w-]+/[\w-]+", str(c["content_type"])):
        yield "content_type", "must be type/subtype"


def _selectors(s: dict) -> Iterator[tuple[str, str]]:
    items = s.get("items")
    if not isinstance(items, dict):
        yield "items", "is missing"
    else:
        if not _text(items.get("selector")):
            yield "items.selector", "must be filled"
        if "order" in items and items["order"] != "reverse":
            yield "items.order", "must be reverse"
        if "enhance" in items and not isinstance(items["enhance"], bool):
            yield "items.enhance", "must be true or false"
        if items.get("pagination") is not None:
            yield from (("items.pagination", m) for m in _pagination(items["pagination"]))
    for name, c in s.items():
        if name == "items":
            continue
        if name in ("guid", "categories") and not isinstance(c, dict):
            if not isinstance(c, list) or not c:
                yield name, "must be a list of selector names"
            else:
                yield from ((name, f"refers to the undefined selector {r}") for r in c if r not in s or r == "items")
        else:
            yield from ((f"{name}.{path}".rstrip("."), m) for path, m in _selector(c, name == "enclosure"))


def problems(config: dict) -> list[tuple[str, str]]:
    """(path, message) of everything wrong with a configuration; none if it is valid."""
    out: list[tuple[str, str]] = []
    channel = config.get("channel")
    if not isinstance(channel, dict):
        out.append(("channel", "is missing"))
        channel = {}
    elif not _absolute(channel.get("url")):
        out.append(("channel.url", "must be an absolute http or https URL without user or @"))
    if channel.get("image") and not _absolute(channel["image"]):
        out.append(("channel.image", "must be an absolute URL"))
    if channel.get("language") is not None and not LANGUAGE.fullmatch(str(channel["language"])):
        out.append(("channel.language", "must look like en or en-US"))
    if channel.get("ttl") is not None and not _natural(channel["ttl"]):
        out.append(("channel.ttl", "must be an integer greater than 0"))
    if "directory" in config:
        d = config["directory"] or {}
        if not _text(d.get("title")):
            out.append(("directory.title", "must be filled"))
        if len(d.get("summary") or "") > 160:
            out.append(("directory.summary", "must have 160 characters at most"))
        if "topics" in d and (not d["topics"] or any(t not in TOPICS for t in d["topics"])):
            out.append(("directory.topics", f"must be some of: {', '.join(TOPICS)}"))
    out += [(f"headers.{k}", "must be a string") for k, v in (config.get("headers") or {}).items() if not isinstance(v, str)]
    for i, s in enumerate(config.get("stylesheets") or []):
        if not _text(s.get("href")):
            out.append((f"stylesheets.{i}.href", "must be filled"))
        if s.get("type") not in STYLESHEET_TYPES:
            out.append((f"stylesheets.{i}.type", f"must be one of: {', '.join(STYLESHEET_TYPES)}"))
    if config.get("strategy", "auto") not in STRATEGIES:
        out.append(("strategy", f"must be one of: {', '.join(STRATEGIES)}"))
    request = config.get("request") or {}
    out += [(f"request.{k}", "is out of range") for k, least in (("max_redirects", 0), ("max_requests", 1), ("total_timeout_seconds", 1)) if k in request and not _natural(request[k], least)]
    if "selectors" not in config and "auto_source" not in config:
        out.append(("", "needs selectors or auto_source"))
    if isinstance(config.get("selectors"), dict):
        out += [(f"selectors.{p}", m) for p, m in _selectors(config["selectors"])]
    auto = config.get("auto_source")
    if isinstance(auto, dict):
        if "limit" in auto and not _natural(auto["limit"]):
            out.append(("auto_source.limit", "must be an integer greater than 0"))
        out += [(f"auto_source.scraper.{k}", "is unknown") for k in auto.get("scraper") or {} if k not in SCRAPERS]
    return out


def problems_frame(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """name, path, message of all problems of many configurations."""
    rows = [(name, path, message) for name, c in configs.items() for path, message in problems(c)]
    return spark.createDataFrame(rows, "name string, path string, message string")


def json_schema() -> dict:
    """The configuration language as a JSON schema."""

    def thing(required: list[str] | None = None, **properties: object) -> dict:
        return {"type": "object", "properties": properties} | ({"required": required} if required else {})

    text, natural, flag = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
    url = {"type": "string", "pattern": "^https?://"}
    step = {"type": "object", "required": ["name"], "properties": {"name": {"enum": sorted(postprocess.STEPS)}}}
    pagination = thing(strategy={"enum": list(PAGERS)}, max_pages=natural, selector=text, param=text, start_page={"type": "integer"}, step={"type": "integer"}, start_offset={"type": "integer"}, increment={"type": "integer"}, cursor_path=text, next_url_path=text)
    names = {"type": "array", "minItems": 1, "items": text}
    selector = thing(selector=text, extractor={"enum": list(EXTRACTORS)}, attribute=text, static=text, content_type=text, post_process={"type": "array", "items": step})
    selectors = thing(["items"], items=thing(["selector"], selector=text, order={"const": "reverse"}, enhance=flag, pagination={"oneOf": [natural, pagination]}), guid={"oneOf": [names, selector]}, categories=names) | {"additionalProperties": selector}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        **thing(
            ["channel"],
            strategy={"enum": list(STRATEGIES)},
            channel=thing(["url"], url=url, title=text, description=text, language={"type": "string", "pattern": f"^{LANGUAGE.pattern}$"}, ttl=natural, time_zone=text, author=text, image=url),
            directory=thing(["title"], title=text, summary={"type": "string", "maxLength": 160}, topics={"type": "array", "minItems": 1, "items": {"enum": list(TOPICS)}}),
            headers={"type": "object", "additionalProperties": text},
            stylesheets={"type": "array", "items": thing(["href", "type"], href=text, type={"enum": list(STYLESHEET_TYPES)}, media=text)},
            parameters={"type": "object"},
            selectors=selectors,
            auto_source=thing(limit=natural, scraper=thing(**{name: thing(enabled=flag) for name in SCRAPERS}), cleanup=thing(keep_different_domain=flag)),
            request=thing(max_redirects={"type": "integer", "minimum": 0}, max_requests=natural, total_timeout_seconds=natural, local_file_path=text),
        ),
        "anyOf": [{"required": ["selectors"]}, {"required": ["auto_source"]}],
    }
