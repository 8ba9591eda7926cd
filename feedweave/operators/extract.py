"""Field extraction from one element: the rules that fill what selectors leave open."""

from __future__ import annotations

import mimetypes
import re
import zlib

from feedweave.dom import css
from feedweave.dom.text import collapse, eligible_link, visible_text
from feedweave.dom.tree import Node
from feedweave.functions import lexicon as L
from feedweave.functions.postprocess import parse_date
from feedweave.functions.urls import resolved

KICKER = '[data-tb-kicker], [class*="kicker"], [class*="eyebrow"], [class*="pre-title"], [class*="pretitle"], [class*="overline"]'
FALLBACK_HEADING = 'strong, b, [class*="title"], [class*="font-bold"], [class*="font-semibold"]'
CATEGORY_WORDS = re.compile(r"categor|^tags?$|topic|section|label|theme|subject", re.I)
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
        if not n:
            return out


def main_anchor(item: Node) -> Node | None:
    return next((n for n in item.walk() if eligible_link(n)), None)


def heading_of(item: Node, anchor: Node | None, below: list[Node] | None = None) -> Node | None:
    """Of the highest heading level the one with the longest text; without headings and anchors a title-like element."""
    found = [n for n in below or item.walk() if n is not item and n.name in L.HEADINGS]
    if found:
        top = min(n.name for n in found)
        best = [n for n in found if n.name == top]
        return best[0] if len(best) == 1 else max(best, key=lambda n: len(visible_text(n) or ""))
    if anchor is None:
        return next((n for n in css.select(item, FALLBACK_HEADING) if (visible_text(n) or "").strip()), None)
    return None


def slug(text: str) -> str | None:
    s = re.sub("[^a-z0-9]+", "-", text.lower())
    return s.removeprefix("-").removesuffix("-") or None


def first_text(item: Node) -> str | None:
    return next((s.strip() for s in item.strings() if s.strip()), None)


def item_id(item: Node, heading: Node | None, url: str | None, anchor: Node | None, below: list[Node] | None = None) -> str | None:
    nested = next((n.attrs["id"] for n in below or item.walk() if n is not item and "id" in n.attrs), None)
    options = [item.attrs.get("id"), nested]
    if anchor is not None and url:
        m = re.match(r"[a-z]+://[^/?#]*([^?#]*)(?:\?([^#]*))?", url)
        options += [m[1], m[2]] if m else []
    found = next((x for x in options if x), None)
    if found:
        return found
    text = visible_text(heading) if heading is not None else None
    if not (text or "").strip():
        text = first_text(item) if anchor is None else None
    if text and text.strip():
        return slug(text)
    whole = (visible_text(item) or "").strip()
    return base36(zlib.crc32(whole.encode())) if anchor is None and whole else None


def clean_line(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip()


def date_core(line: str) -> str:
    for sep in L.CHIP_SEPARATORS:
        left, found, right = line.rpartition(sep)
        if found:
            if right.lower() in L.TYPE_CHIPS or re.search(L.CLOCK_ZONE, right):
                return left
            if left.lower() in L.TYPE_CHIPS:
                return right
    return line


_SHAPES = [re.compile(p.replace(r"\p{L}", r"[^\W\d_]")) for p in L.DATE_SHAPES]


def date_shaped(line: str) -> bool:
    core = date_core(line)
    return 0 < len(core) <= L.MAX_DATE_CHARS and any(p.search(core) for p in _SHAPES)


def keep_line(line: str, title: str | None, *, chips: bool = True) -> bool:
    key, t = line.lower(), (title or "").strip().lower()
    return bool(line) and not (key in L.CTA or (chips and key in L.TYPE_CHIPS) or key in L.SECTION_NAMES or line.endswith(":") or date_shaped(line) or (t and key == t))


def leftover(item: Node, exclude: list[Node | None]) -> list[str]:
    text = visible_text(item, tuple(n for n in exclude if n is not None))
    return [x for x in (clean_line(s) for s in re.split(r"\n+", text or "")) if x]


def srcset_largest(value: str) -> str | None:
    best, size = None, -1.0
    for part in re.split(r",\s+|,(?=https?:|/)", value[:4096]):
        bits = part.split()
        if bits and not bits[0].startswith("data:"):
            m = re.fullmatch(r"([\d.]+)[wx]", bits[1]) if len(bits) > 1 else None
            n = float(m[1]) if m else 0.0
            if n >= size:
                best, size = bits[0], n
    return best


def image_of(item: Node, base: str, below: list[Node] | None = None) -> str | None:
    """Largest srcset candidate, else an img source, else a url() of a style."""
    below = [n for n in below or item.walk() if n.attrs]
    for n in below:
        if n.attrs.get("srcset"):
            got = srcset_largest(n.attrs["srcset"])
            if got:
                return resolved(got, base)
    for n in below:
        src = n.attrs.get("src", "")
        if n.name == "img" and src and not src.startswith("data:"):
            return resolved(src, base)
    styles = [m for n in below if "style" in n.attrs for m in re.findall(r"url\(\s*['\"]?(.*?)['\"]?\s*\)", n.attrs.get("style", "")[:4096]) if not m.startswith("data:")]
    return resolved(max(styles, key=len), base) if styles else None


def enclosure(url: str, kind: str | None = None) -> dict:
    return {"url": url, "type": kind or mimetypes.guess_type(url.split("?")[0])[0] or "application/octet-stream", "bytes_length": 0}


def enclosures_of(item: Node, base: str, below: list[Node] | None = None) -> list[dict]:
    out: list[dict] = []
    for n in below or item.walk():
        if not n.attrs:
            continue
        src, href = n.attrs.get("src", ""), n.attrs.get("href", "")
        if n.name == "img" and src and not src.startswith("data:"):
            out.append(enclosure(resolved(src, base) or src, None if mimetypes.guess_type(src)[0] else "image/jpeg"))
        elif (n.name == "source" and src and n.parent and n.parent.name in ("video", "audio")) or (n.name in ("audio", "video") and src):
            out.append(enclosure(resolved(src, base) or src, n.attrs.get("type")))
        elif n.name == "iframe" and src:
            out.append(enclosure(resolved(src, base) or src, "text/html"))
        elif n.name == "a" and re.search(r"\.(pdf|zip|tar\.gz|tgz)$", href.split("?")[0], re.I):
            out.append(enclosure(resolved(href, base) or href))
    seen: dict[str, dict] = {}
    for e in out:
        seen.setdefault(e["url"], e)
    return list(seen.values())


def categories_of(item: Node, title: str | None, below: list[Node] | None = None) -> list[str]:
    """Texts of elements whose class or data attribute names a category; anchors inside count one by one."""
    out: list[str] = []
    for n in below or item.walk():
        if not n.attrs:
            continue
        named = any(CATEGORY_WORDS.search(t) for t in n.classes())
        values = [v for k, v in n.attrs.items() if k.startswith("data-") and CATEGORY_WORDS.search(k[5:])]
        if named:
            links = [x for x in n.walk() if x is not n and x.name == "a"]
            values += [visible_text(x) or "" for x in links] if links else [visible_text(n) or ""] if not any(c.name in L.BLOCKS for c in n.elements()) else []
        out += [c for c in (clean_line(v) for v in values) if keep_line(c, title, chips=False)]
    return list(dict.fromkeys(out))


def dates_of(item: Node, lines: list[str], below: list[Node] | None = None) -> list[str]:
    """Texts that may be the item's date: machine dates, then date-shaped lines. The earliest that can be read counts."""
    stamps = [n.attrs["datetime"].strip() for n in below or item.walk() if n.attrs.get("datetime", "").strip()]
    return list(dict.fromkeys([*stamps, *(date_core(x) for x in lines if date_shaped(x))]))


def dated(texts: list[str]) -> bool:
    for text in texts:
        try:
            parse_date(text)
        except ValueError:
            continue
        return True
    return False


def parent_card(item: Node) -> Node | None:
    """The nearest element above that is no landmark and holds more than the way to the item; null if it looks like a listing.

    A listing has more than one heading or main links to more than one target.
    """
    card = next((n for n in item.ancestors() if n.name not in L.CARD_STOPS and len(n.elements()) > 1), None)
    if card is None:
        return None
    below = [n for n in card.walk() if n is not card]
    targets = {n.attrs["href"] for n in below if n.name == "a" and n.attrs.get("href") and not n.attrs["href"].startswith(L.SKIP_HREF)}
    return None if len(targets) > 1 or sum(n.name in L.HEADINGS for n in below) > 1 else card


def extract(item: Node, base: str, anchor: Node | None = None, *, fallback_anchorless: bool = True) -> dict:
    """All article fields of an item element; text, date and categories of a bare heading or link come from its card."""
    below = list(item.walk())
    heading = heading_of(item, anchor, below)
    source = heading if heading is not None else anchor
    title = visible_text(source) if source is not None else first_text(item)
    kicker = css.first(item, KICKER)
    if kicker is not None and heading is not None and (kicker is heading or heading in kicker.ancestors()):
        kicker = None
    if title and kicker is not None:
        lead = collapse(visible_text(kicker) or "")
        title = f"{lead}: {title}" if lead and lead not in title else title
    href = anchor.attrs.get("href", "") if anchor is not None else ""
    url = resolved(href.split("#")[0].strip(), base) if href else None
    ident = item_id(item, heading, url, anchor, below)
    if url is None and fallback_anchorless and ident:
        url = resolved(f"#{ident}", base)

    def said(node: Node, below: list[Node]) -> tuple[list[str], list[str]]:
        lines = leftover(node, [heading, anchor, kicker, *[n for n in below if n.name == "time"]])
        return lines, [x for x in lines if keep_line(x, title)]

    lines, kept = said(item, below)
    dates, source, around = dates_of(item, lines, below), item, below
    if item.name in (*L.HEADINGS, "a") and not kept and not dated(dates):
        card = parent_card(item)
        if card is not None:
            around = list(card.walk())
            lines, kept = said(card, around)
            dates, source = dates_of(card, lines, around) or dates, card
    return {
        "title": title,
        "url": url,
        "image": image_of(item, base, below),
        "description": "\n".join(kept) or None,
        "id": ident,
        "published_at": "\n".join(dates) or None,
        "enclosures": enclosures_of(item, base, below),
        "categories": categories_of(source, title, around),
    }
