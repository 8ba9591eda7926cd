"""Value transforms of selector fields: by value for the page-local engine, and as column expressions where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import format_datetime, parsedate_to_datetime
from html import escape
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.dom.tree import VOID, Node, parse
from feedweave.functions import dates
from feedweave.functions.urls import resolved


class MissingOption(ValueError):
    """A step without a required option."""


class InvalidType(TypeError):
    """A value of the wrong type."""


#: What sanitized HTML may hold.
ALLOWED = frozenset(
    "a abbr address article aside audio b bdi bdo blockquote br caption cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i iframe img ins kbd li main mark nav ol p picture pre q rp rt ruby s samp section small source span strong sub summary sup table tbody td tfoot th thead time tr u ul var video wbr".split()
)
ALLOWED_ATTRS = frozenset("href src srcset alt title width height datetime cite colspan rowspan type controls poster lang dir start abbr headers scope span".split())
FORCED = {"a": {"rel": "nofollow noopener noreferrer", "target": "_blank"}, "img": {"referrerpolicy": "no-referrer"}, "iframe": {"referrerpolicy": "no-referrer"}, "video": {"referrerpolicy": "no-referrer", "controls": "true"}, "audio": {"referrerpolicy": "no-referrer", "controls": "true"}}
DROPPED_WHOLE = frozenset("script style template noscript svg math head title".split())


def pattern_of(text: str) -> str:
    return text[1:-1] if len(text) >= 3 and text[0] == text[-1] == "/" else text


def gsub(value: str, pattern: str, replacement: str | dict) -> str:
    """Blanks in the pattern do not count and case does not matter; a dict maps matches to values."""
    rx = re.compile(pattern_of(pattern), re.VERBOSE | re.IGNORECASE)
    if isinstance(replacement, dict):
        return rx.sub(lambda m: str(replacement.get(m[0], "")), value)
    plain = re.sub(r"\\(\d)", r"\\g<\1>", replacement)
    return rx.sub(plain, value)


def gsub_column(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, "(?ix)" + pattern_of(pattern), re.sub(r"\\(\d)", r"$\1", replacement))


def substring(value: str, start: int, end: int | None = None) -> str | None:
    """Characters from start to end, both included, negative from the end."""
    if end is not None and start == end:
        raise ValueError("substring: start equals end")
    n = len(value)
    first = start + n if start < 0 else start
    last = n - 1 if end is None else end + n if end < 0 else end
    return value[first : last + 1] if 0 <= first <= n else None


def substring_column(value: Column, start: int, end: int | None = None) -> Column:
    if end is not None and start == end:
        raise ValueError("substring: start equals end")
    n = F.length(value)
    first = n + start if start < 0 else F.lit(start)
    last = n - 1 if end is None else n + end if end < 0 else F.lit(end)
    return F.when((first >= 0) & (first <= n), F.substr(value, first + 1, F.greatest(last - first + 1, F.lit(0))))


_FIELD = re.compile(r"%\{(\w+)\}|%<(\w+)>s")


def template(text: str, fields) -> str:
    """``%{name}`` and ``%<name>s`` from fields (a callable by name)."""
    return _FIELD.sub(lambda m: str(fields(m[1] or m[2]) or ""), text)


def template_column(text: str, fields: dict[str, Column]) -> Column:
    parts, at = [], 0
    for m in _FIELD.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(fields[m[1] or m[2]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%B %d, %Y %H:%M", "%d %B %Y %H:%M", "%B %d, %Y at %I:%M %p", "%d/%m/%Y", "%A, %B %d, %Y", "%A, %B %d, %Y %I:%M %p")


def parse_date(text: str, zone: str = "UTC") -> datetime:
    """ISO, mail and common prose dates; times without an offset are of the zone; text without a day is an error."""
    raw = re.sub(r"\s+", " ", text).strip()
    if not raw:
        raise ValueError("no time in an empty text")
    try:
        got = datetime.fromisoformat(raw)
    except ValueError:
        try:
            got = parsedate_to_datetime(raw)
        except (ValueError, TypeError):
            for f in _FORMATS:
                try:
                    got = datetime.strptime(raw, f)  # noqa: DTZ007
                    break
                except ValueError:
                    continue
            else:
                raise ValueError(f"no time in {text!r}") from None
    return got if got.tzinfo else localized(got, zone)


def localized(local: datetime, zone: str) -> datetime:
    """A local time of a zone: standard time where a clock change repeats it, UTC where it is skipped or the zone is unknown."""
    try:
        there = local.replace(tzinfo=ZoneInfo(zone), fold=1)
    except (ZoneInfoNotFoundError, ValueError):
        return local.replace(tzinfo=timezone.utc)
    kept = there.astimezone(timezone.utc).astimezone(there.tzinfo).replace(tzinfo=None) == local
    return there if kept else local.replace(tzinfo=timezone.utc)


def parse_time(value: str, zone: str = "UTC") -> str:
    return format_datetime(parse_date(value, zone))


def parse_time_column(value: Column, zone: str = "UTC") -> Column:
    """A text column as mail time, as parse_time does for one text; null where it is no date."""
    return dates.mail(dates.moment(value, zone))


def parse_uri(value: str, base: str) -> str:
    if not value.strip():
        raise ValueError("parse_uri: blank")
    return resolved(value, base) or ""


def folded(root: Node, text: Callable[[str], str], element: Callable[[Node, str, int], str], enter: Callable[[Node], bool] = lambda _: True) -> str:
    """The tree as one text, from the leaves up: element gets a node, the text of its children and how many lists it is in.

    Open elements are kept in a list, so nesting of any depth is read. What is not entered gives nothing.
    """
    open_: list[tuple[Node, Iterator, list[str], int]] = [(root, iter(root.children), [], 0)]
    while True:
        node, children, parts, lists = open_[-1]
        for c in children:
            if isinstance(c, str):
                parts.append(text(c))
            elif enter(c):
                open_.append((c, iter(c.children), [], lists + (node.name in ("ul", "ol"))))
                break
        else:
            open_.pop()
            body = "".join(parts)
            if not open_:
                return body
            open_[-1][2].append(element(node, body, lists))


def _sanitized(root: Node, base: str) -> str:
    def element(c: Node, body: str, _lists: int) -> str:
        if c.name not in ALLOWED:
            return body
        attrs = {k: v for k, v in c.attrs.items() if k in ALLOWED_ATTRS and not v.strip().lower().startswith(("javascript:", "vbscript:"))}
        for k in ("href", "src"):
            if k in attrs and c.name in ("a", "img", "iframe", "audio", "video", "source"):
                attrs[k] = resolved(attrs[k], base) or attrs[k]
        tag = f"<{c.name}{''.join(f' {k}="{escape(v)}"' for k, v in (attrs | FORCED.get(c.name, {})).items())}>"
        html = tag if c.name in VOID else f"{tag}{body}</{c.name}>"
        if c.name == "img" and not any(a.name == "a" for a in c.ancestors()) and attrs.get("src"):
            html = f'<a href="{escape(attrs["src"])}"{"".join(f' {k}="{v}"' for k, v in FORCED["a"].items())}>{html}</a>'
        return html

    return folded(root, lambda x: escape(x, quote=False), element, lambda c: c.name not in DROPPED_WHOLE)


def sanitize_html(value: str, base: str) -> str | None:
    """Allowed elements and attributes only, absolute URLs, lone images as links; null if nothing is left."""
    html = _sanitized(parse(value), base)
    html = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", html)).strip()
    return html or None


def html_to_markdown(value: str, base: str) -> str:
    """Headings, emphasis, links, images, lists, code, quotes and rules."""

    def one(n: Node, body: str, depth: int) -> str:
        bare = body.strip()
        if n.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return f"\n\n{'#' * int(n.name[1])} {bare}\n\n"
        if n.name in ("strong", "b"):
            return f"**{bare}**" if bare else ""
        if n.name in ("em", "i"):
            return f"_{bare}_" if bare else ""
        if n.name == "code":
            return f"`{bare}`"
        if n.name == "pre":
            return f"\n\n```\n{n.text()}\n```\n\n"
        if n.name == "a":
            return f"[{bare}]({n.attrs['href']})" if n.attrs.get("href") else body
        if n.name == "img":
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
        if n.name == "br":
            return "  \n"
        if n.name == "hr":
            return "\n\n* * *\n\n"
        if n.name == "li":
            mark = "-"
            if n.parent is not None and n.parent.name == "ol":
                mark = f"{[x for x in n.parent.elements() if x.name == 'li'].index(n) + 1}."
            return f"{'  ' * max(0, depth - 1)}{mark} {bare}\n"
        if n.name in ("ul", "ol"):
            return f"\n{body}\n"
        if n.name == "blockquote":
            return "\n\n" + "\n".join(f"> {x}" for x in bare.split("\n")) + "\n\n"
        if n.name in ("p", "div", "section", "article"):
            return f"\n\n{bare}\n\n"
        return body

    clean = sanitize_html(value, base)
    return re.sub(r"\n{3,}", "\n\n", folded(parse(clean), str, one)).strip() + "\n" if clean else ""


def _inline(text: str) -> str:
    text = escape(text, quote=False)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1">', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    text = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", text)
    return re.sub(r"(?<!\w)[*_](.+?)[*_](?!\w)", r"<em>\1</em>", text)


def markdown_to_html(value: str, base: str) -> str | None:
    """Blocks (headings, lists, quotes, code, rules, paragraphs) and inline marks; the result is sanitized."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", value.replace("\r\n", "\n").strip()):
        lines = block.split("\n")
        if m := re.fullmatch(r"(#{1,6})\s+(.*?)\s*#*", lines[0]):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            lines = lines[1:]
            if not lines:
                continue
        if lines[0].startswith("```"):
            out.append(f"<pre><code>{escape(chr(10).join(lines[1:-1]))}</code></pre>")
        elif re.fullmatch(r"([-*_] ?){3,}", lines[0]):
            out.append("<hr>")
        elif all(re.match(r"\s*[-*+]\s", x) for x in lines):
            out.append("<ul>" + "".join(f"<li>{_inline(re.sub(r'^\s*[-*+]\s+', '', x))}</li>" for x in lines) + "</ul>")
        elif all(re.match(r"\s*\d+\.\s", x) for x in lines):
            out.append("<ol>" + "".join(f"<li>{_inline(re.sub(r'^\s*\d+\.\s+', '', x))}</li>" for x in lines) + "</ol>")
        elif all(x.startswith(">") for x in lines):
            out.append(f"<blockquote><p>{_inline(chr(10).join(x.lstrip('> ') for x in lines))}</p></blockquote>")
        else:
            out.append(f"<p>{_inline(chr(10).join(lines))}</p>")
    return sanitize_html("\n\n".join(out), base)


#: Step name: (function of value, options and context; required options).
STEPS = {
    "gsub": (lambda v, o, c: gsub(v, o["pattern"], o["replacement"]), ("pattern", "replacement")),
    "substring": (lambda v, o, c: substring(v, o["start"], o.get("end")), ("start",)),
    "template": (lambda v, o, c: template(o["string"], lambda k: v if k == "self" else c.field(k)), ("string",)),
    "parse_time": (lambda v, o, c: parse_time(v, c.time_zone), ()),
    "parse_uri": (lambda v, o, c: parse_uri(v, c.base), ()),
    "sanitize_html": (lambda v, o, c: sanitize_html(v, c.base), ()),
    "html_to_markdown": (lambda v, o, c: html_to_markdown(v, c.base), ()),
    "markdown_to_html": (lambda v, o, c: markdown_to_html(v, c.base), ()),
}


def check_step(step: dict) -> None:
    """Plan-time check of a step's name and options."""
    if step.get("name") not in STEPS:
        raise ValueError(f"unknown post processor {step.get('name')!r}")
    missing = [o for o in STEPS[step["name"]][1] if o not in step]
    if missing:
        raise MissingOption(f"{step['name']}: {', '.join(missing)}")


def apply_step(value: object, step: dict, context: object) -> str | None:
    if not isinstance(value, str):
        raise InvalidType(f"{step['name']} takes text, not {type(value).__name__}")
    return STEPS[step["name"]][0](value, step, context)
