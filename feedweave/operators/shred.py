"""The node relation: every page once through the parser, one row per element with interval labels.

A descendant of node a is a row d with a.node_id < d.node_id <= a.last_desc on the same page, so tree questions become
range predicates and window functions. A page of more than lexicon.MAX_NODES elements keeps structural ones only from
there on (lexicon.DEGRADED_TAGS), with nothing below the others; its rows say degraded. Nesting may be of any depth.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedweave.dom.text import eligible_link, silent, visible_text
from feedweave.dom.tree import Node, parse
from feedweave.functions.lexicon import CHROME_ROOTS, CLUSTER_DATE, DEGRADED_TAGS, HEADINGS, KEPT_ATTRIBUTES, LANDMARKS, MAX_NODES, STRIPPED

#: Columns of the relation. visible_text is that of links, headings and body; words counts the visible words of every element;
#: own_date tells that a text of the element itself, seen from outside, holds a date: texts of neighbours never touch, so an
#: element's visible text holds one where it or an element below it does. landmark_id is the nearest landmark above, -1 without
#: one; boundary_id the nearest element from it upwards whose parent has more links, null from body on.
COLUMNS = {
    "page_id": ("long", pa.int64()),
    "node_id": ("int", pa.int32()),
    "last_desc": ("int", pa.int32()),
    "parent_id": ("int", pa.int32()),
    "depth": ("int", pa.int32()),
    "tag": ("string", pa.string()),
    "tag_path": ("string", pa.string()),
    "href": ("string", pa.string()),
    "dom_id": ("string", pa.string()),
    "class_names": ("array<string>", pa.list_(pa.string())),
    "datetime": ("string", pa.string()),
    "itemprop": ("string", pa.string()),
    "rel": ("string", pa.string()),
    "attributes": ("map<string,string>", pa.map_(pa.string(), pa.string())),
    "own_text": ("string", pa.string()),
    "own_date": ("boolean", pa.bool_()),
    "visible_text": ("string", pa.string()),
    "words": ("int", pa.int32()),
    "chrome": ("boolean", pa.bool_()),
    "is_link": ("boolean", pa.bool_()),
    "is_heading": ("boolean", pa.bool_()),
    "non_leaf": ("boolean", pa.bool_()),
    "child_tags": ("string", pa.string()),
    "landmark_id": ("int", pa.int32()),
    "boundary_id": ("int", pa.int32()),
    "degraded": ("boolean", pa.bool_()),
    "all_attributes": ("map<string,string>", pa.map_(pa.string(), pa.string())),
    "text": ("string", pa.string()),
}
#: What is given unless asked otherwise: all but every attribute and the whole text of every element.
USUAL = tuple(c for c in COLUMNS if c not in ("all_attributes", "text"))
ROWS = 8192
_KEPT = regex.compile(KEPT_ATTRIBUTES, regex.IGNORECASE)
_DATE = regex.compile(CLUSTER_DATE)
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def elements(root: Node) -> tuple[list[tuple[Node, int, int, str, bool]], list[int], bool]:
    """(node, parent, depth, path, chrome) of the kept elements in document order, last descendants, whether it degraded."""
    out: list[tuple[Node, int, int, str, bool]] = []
    last: list[int] = []
    degraded = False
    pending: list = [(n, -1, 0, "", False) for n in reversed(root.elements())]
    while pending:
        n, parent, depth, path, chrome = pending.pop()
        if n is None:
            last[parent] = len(out) - 1
            continue
        degraded = degraded or (len(out) >= MAX_NODES and n.name not in STRIPPED)
        if n.name in STRIPPED or (degraded and n.name not in DEGRADED_TAGS):
            continue
        me, path, chrome = len(out), f"{path}>{n.name}" if path else n.name, chrome or n.name in CHROME_ROOTS
        out.append((n, parent, depth, path, chrome))
        last.append(me)
        kids = n.elements()
        if kids:
            pending.append((None, me, 0, "", False))
            pending.extend((c, me, depth + 1, path, chrome) for c in reversed(kids))
    return out, last, degraded


def numbered(root: Node) -> list[Node]:
    """Elements by their node_id."""
    return [n for n, *_ in elements(root)[0]]


def word_counts(root: Node) -> dict[int, int]:
    """Visible words by id() of each element: children are set apart by a space or line end, so counts add up."""
    order = list(root.walk())
    count = {id(n): sum(len(_WORD.findall(c)) for c in n.children if isinstance(c, str)) for n in order}
    for n in reversed(order):
        if n.parent is not None and not silent(n):
            count[id(n.parent)] += count[id(n)]
    return count


def boundaries(kept: list[tuple[Node, int, int, str, bool]]) -> list[int | None]:
    """Of each element the nearest from it upwards whose parent has more links; a link counts as one, whatever is in it."""
    links = [int(eligible_link(n)) for n, *_ in kept]
    below = list(links)
    for i in range(len(kept) - 1, 0, -1):
        if kept[i][1] >= 0:
            below[kept[i][1]] += below[i]
    count = [1 if link else b for link, b in zip(links, below, strict=True)]
    out: list[int | None] = []
    for i, (n, parent, _, _, chrome) in enumerate(kept):
        if parent < 0 or n.name == "body":
            out.append(None)
        else:
            out.append(i if not chrome and count[parent] > count[i] else out[parent])
    return out


def rows(page_id: int | None, root: Node, columns: tuple[str, ...] = USUAL) -> dict[str, list]:
    """The asked-for columns of one page, as lists."""
    kept, last, degraded = elements(root)
    want = set(columns)
    out: dict[str, list] = {}

    def put(name: str, value) -> None:
        if name in want:
            out[name] = [value(*k) for k in kept]

    put("page_id", lambda *_: page_id)
    if "node_id" in want:
        out["node_id"] = list(range(len(kept)))
    if "last_desc" in want:
        out["last_desc"] = last
    put("parent_id", lambda _n, parent, *_: parent)
    put("depth", lambda _n, _p, depth, *_: depth)
    put("tag", lambda n, *_: n.name)
    put("tag_path", lambda _n, _p, _d, path, _c: path)
    put("href", lambda n, *_: n.attrs.get("href"))
    put("dom_id", lambda n, *_: n.attrs.get("id") or None)
    put("class_names", lambda n, *_: n.classes())
    put("datetime", lambda n, *_: n.attrs.get("datetime") or None)
    put("itemprop", lambda n, *_: n.attrs.get("itemprop") or None)
    put("rel", lambda n, *_: n.attrs.get("rel") or None)
    put("attributes", lambda n, *_: [(k, v) for k, v in n.attrs.items() if _KEPT.match(k)])
    put("own_text", lambda n, *_: "".join(c for c in n.children if isinstance(c, str)))
    if "own_date" in want:
        quiet: set[int] = set()
        for i, (n, parent, *_) in enumerate(kept):
            if parent in quiet or silent(n):
                quiet.add(i)
        out["own_date"] = [i not in quiet and any(isinstance(c, str) and _DATE.search(c) is not None for c in n.children) for i, (n, *_) in enumerate(kept)]
    put("visible_text", lambda n, *_: visible_text(n) if n.name in HEADINGS or n.name == "body" or eligible_link(n) else None)
    if "words" in want:
        count = word_counts(root)
        put("words", lambda n, *_: count[id(n)])
    put("chrome", lambda _n, _p, _d, _path, chrome: chrome)
    put("is_link", lambda n, *_: eligible_link(n))
    put("is_heading", lambda n, *_: n.name in HEADINGS)
    if "non_leaf" in want:
        flags = [False] * len(kept)
        open_: defaultdict[str, list[int]] = defaultdict(list)
        for i, (n, *_) in enumerate(kept):
            same = open_[n.name]
            while same and last[same[-1]] < i:
                same.pop()
            if same:
                flags[same[-1]] = True
            same.append(i)
        out["non_leaf"] = flags
    if "child_tags" in want:
        names: list[list[str]] = [[] for _ in kept]
        for n, parent, *_ in kept:
            if parent >= 0:
                names[parent].append(n.name)
        out["child_tags"] = [">".join(x) for x in names]
    if "landmark_id" in want:
        near: list[int] = []
        for _, parent, *_ in kept:
            near.append(-1 if parent < 0 else parent if kept[parent][0].name in LANDMARKS else near[parent])
        out["landmark_id"] = near
    if "boundary_id" in want:
        out["boundary_id"] = boundaries(kept)
    put("degraded", lambda *_: degraded)
    put("all_attributes", lambda n, *_: list(n.attrs.items()))
    put("text", lambda n, *_: n.text())
    return out


def shred(pages: DataFrame, key: str = "page_id", html: str = "html", columns: tuple[str, ...] = USUAL) -> DataFrame:
    """key, html to nodes with the asked-for columns. A null page has none."""
    schema = pa.schema([(c, COLUMNS[c][1]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in schema], schema=schema)
            for x in held.values():
                x.clear()
            return out

        for b in batches:
            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if body.is_valid:
                    for c, x in rows(k, parse(body.as_py()), columns).items():
                        held[c].extend(x)
                    if len(held[columns[0]]) >= ROWS:
                        yield batch()
        if held[columns[0]]:
            yield batch()

    return pages.select(key, html).mapInArrow(run, ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))
