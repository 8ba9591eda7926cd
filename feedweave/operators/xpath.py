"""XPath location paths as joins and windows over the node relation.

A path is a list of steps; each step turns the set of elements found so far into the next set with one semi join (child,
parent, self) or one sweep over the page (descendants, ancestors, siblings), so no pairs of elements are made. Tests in
brackets become column expressions; a number counts elements of one parent.

Read are: ``/`` and ``//``, the axes of AXES and their short forms, names, ``*``, ``|``, a last ``@name``, and in brackets
numbers, ``last()``, ``and``, ``or``, ``not()``, ``=``, ``!=``, ``contains``, ``starts-with``, ``normalize-space`` over ``@name``,
``text()``, ``.`` and quoted texts. Others are an XPathError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self", "following-sibling", "preceding-sibling")
#: Columns of the node relation that paths need.
NODES = ("page_id", "node_id", "last_desc", "parent_id", "tag", "all_attributes", "own_text", "text")
_TOKEN = re.compile(r"\s*(//|/|\.\.|::|!=|[|@.*()\[\],=]|\d+|\"[^\"]*\"|'[^']*'|[A-Za-z_][\w-]*)")


class XPathError(ValueError):
    """A path outside of what is read."""


@dataclass
class Step:
    axis: str
    name: str = "*"
    tests: list = field(default_factory=list)
    loose: bool = False  # after //: positions count among the elements of a parent


class _Reader:
    def __init__(self, path: str) -> None:
        self.tokens, at = [], 0
        path = path.strip()
        while at < len(path):
            m = _TOKEN.match(path, at)
            if not m:
                raise XPathError(f"cannot read {path[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want is not None and got != want):
            raise XPathError(f"expected {want or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def path(self) -> tuple[list[Step], str | None]:
        steps: list[Step] = []
        if self.peek() not in ("/", "//"):
            attribute = self.step(steps, loose=False)
        else:
            attribute = None
        while self.peek() in ("/", "//"):
            if attribute:
                raise XPathError("steps after an attribute")
            attribute = self.step(steps, loose=self.take() == "//")
        return steps, attribute

    def step(self, steps: list[Step], *, loose: bool) -> str | None:
        """Adds a step; the name of an attribute step is returned."""
        if self.peek() == "@":
            self.take()
            if loose:
                steps.append(Step("descendant-or-self"))
            return self.take()
        if self.peek() in (".", ".."):
            if loose:
                steps.append(Step("descendant-or-self"))
            steps.append(Step("self" if self.take() == "." else "parent"))
            return None
        axis = "child"
        if self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in AXES:
                raise XPathError(f"axis {axis}")
        name = self.take()
        if self.peek() == "(" and name == "node":
            self.take("(")
            self.take(")")
            name = "*"
        if name != "*" and not re.fullmatch(r"[A-Za-z_][\w-]*", name):
            raise XPathError(f"name {name!r}")
        if loose and axis != "child":
            steps.append(Step("descendant-or-self"))
        step = Step("descendant" if loose and axis == "child" else axis, name.lower(), loose=loose and axis == "child")
        while self.peek() == "[":
            self.take()
            step.tests.append(self.either())
            self.take("]")
        steps.append(step)
        return None

    def either(self):
        left = self.both()
        while self.peek() == "or":
            self.take()
            right = self.both()
            left = ("or", left, right)
        return left

    def both(self):
        left = self.compared()
        while self.peek() == "and":
            self.take()
            right = self.compared()
            left = ("and", left, right)
        return left

    def compared(self):
        left = self.value()
        if self.peek() in ("=", "!="):
            return (self.take(), left, self.value())
        return left

    def value(self):
        t = self.take()
        if t == "@":
            return ("@", self.take())
        if t == ".":
            return (".",)
        if t == "(":
            inner = self.either()
            self.take(")")
            return inner
        if t[0] in "\"'":
            return ("text", t[1:-1])
        if t.isdigit():
            return ("at", int(t))
        if self.peek() == "(" and t in ("not", "contains", "starts-with", "normalize-space", "text", "last"):
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.either())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            if len(args) not in {"not": (1,), "contains": (2,), "starts-with": (2,), "normalize-space": (0, 1)}.get(t, (0,)):
                raise XPathError(f"{t}() with {len(args)} values")
            return (t, *args)
        raise XPathError(f"cannot read {t!r} in brackets")


def compile_path(path: str) -> list[tuple[list[Step], str | None]]:
    """The parts of a union, each with its steps and the attribute it ends in."""
    r = _Reader(path)
    parts = [r.path()]
    while r.peek() == "|":
        r.take()
        parts.append(r.path())
    if r.at < len(r.tokens) or not all(steps or attribute for steps, attribute in parts):
        raise XPathError(f"cannot read {path!r}")
    for steps, _ in parts:
        for s in steps:
            for t in s.tests:
                if t[0] in ("at", "last"):
                    near = s.axis.endswith("sibling") and t == ("at", 1)
                    if not (s.axis == "child" or s.loose or near or (s.axis == "descendant" and s is steps[0])):
                        raise XPathError(f"a number on the axis {s.axis}")
                else:
                    _truth(t)
    return parts


def _text(t: tuple) -> Column:
    kind = t[0]
    if kind == "@":
        return F.col("all_attributes")[t[1]]
    if kind == "text" and len(t) == 2:
        return F.lit(t[1])
    if kind == "text":
        return F.col("own_text")
    if kind == ".":
        return F.col("text")
    if kind == "normalize-space":
        return F.trim(F.regexp_replace(_text(t[1]) if len(t) > 1 else F.col("text"), r"[ \t\r\n]+", " "))
    raise XPathError(f"{kind} is no text")


def _truth(t: tuple) -> Column:
    kind = t[0]
    if kind in ("and", "or"):
        a, b = _truth(t[1]), _truth(t[2])
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~_truth(t[1])
    if kind in ("=", "!="):
        a, b = _text(t[1]), _text(t[2])
        return F.coalesce(a == b if kind == "=" else a != b, F.lit(False))
    if kind in ("contains", "starts-with"):
        a, b = F.coalesce(_text(t[1]), F.lit("")), F.coalesce(_text(t[2]), F.lit(""))
        return F.contains(a, b) if kind == "contains" else F.startswith(a, b)
    if kind == "@":
        return _text(t).isNotNull()
    return F.coalesce(_text(t), F.lit("")) != ""


def _page(*by: str, down: bool = False) -> Window:
    return Window.partitionBy("page_id", *by).orderBy(F.desc("node_id") if down else F.col("node_id")).rowsBetween(Window.unboundedPreceding, -1)


def _moved(nodes: DataFrame, found: DataFrame | None, step: Step) -> DataFrame:
    """Elements on an axis of those found; found None is the document."""
    axis = step.axis
    if found is None:
        if axis == "child":
            return nodes.where("parent_id < 0")
        return nodes if axis.startswith("descendant") else nodes.where(F.lit(False))
    if axis == "self":
        return nodes.join(found.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    if axis == "child":
        return nodes.join(found.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
    if axis == "parent":
        return nodes.join(found.select("page_id", F.col("parent_id").alias("node_id")), ["page_id", "node_id"], "left_semi")
    marked = nodes.join(found.select("page_id", "node_id", F.lit(True).alias("_hit")), ["page_id", "node_id"], "left")
    own = F.col("_hit").isNotNull() if axis.endswith("-or-self") else F.lit(False)
    if axis.startswith("descendant"):
        inside = F.max(F.when(F.col("_hit"), F.col("last_desc"))).over(_page()) >= F.col("node_id")
    elif axis.startswith("ancestor"):
        inside = F.min(F.when(F.col("_hit"), F.col("node_id"))).over(_page(down=True)) <= F.col("last_desc")
    else:
        before = _page("parent_id", down=axis == "preceding-sibling")
        nearest = F.last(F.when(F.col("_hit"), F.col("node_id")), ignorenulls=True).over(before)
        return marked.withColumn("_near", nearest).where("_near is not null").drop("_hit")
    return marked.withColumn("_in", F.coalesce(inside, F.lit(False)) | own).where("_in").drop("_hit", "_in")


def _walk(nodes: DataFrame, steps: list[Step]) -> DataFrame:
    found = None
    for step in steps:
        hits = _moved(nodes, found, step)
        if step.name != "*":
            hits = hits.where(F.col("tag") == step.name)
        for t in step.tests:
            if t[0] in ("at", "last"):
                by = ["page_id", "_near"] if "_near" in hits.columns else ["page_id", "parent_id"] if step.axis == "child" or step.loose else ["page_id"]
                down = t[0] == "last" or step.axis == "preceding-sibling"
                order = Window.partitionBy(*by).orderBy(F.desc("node_id") if down else F.col("node_id"))
                hits = hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == (t[1] if t[0] == "at" else 1)).drop("_k")
            else:
                hits = hits.where(_truth(t))
        found = hits.select(*nodes.columns)
    return nodes.where(F.lit(False)) if found is None else found


def select(nodes: DataFrame, path: str) -> DataFrame:
    """page_id, node_id, href, value of the elements of a path; value is that of the attribute it ends in, else null."""
    out = None
    for steps, attribute in compile_path(path):
        found = _walk(nodes, steps)
        value = F.lit(None).cast("string")
        if attribute:
            value = F.col("all_attributes")[attribute]
            found = found.where(value.isNotNull())
        rows = found.select("page_id", "node_id", F.col("all_attributes")["href"].alias("href"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def first(nodes: DataFrame, path: str) -> DataFrame:
    """The first of these elements of each page."""
    return select(nodes, path).groupBy("page_id").agg(F.min(F.struct("node_id", "href", "value")).alias("_f")).select("page_id", "_f.*")
