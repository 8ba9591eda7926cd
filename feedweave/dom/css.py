"""CSS selectors: types, ids, classes, attributes, :not and child positions, all four combinators, lists."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from feedweave.dom.tree import Node


class SelectorError(ValueError):
    """A selector outside the supported subset."""


@dataclass(frozen=True)
class Compound:
    name: str = "*"
    tests: tuple = field(default=())

    def matches(self, n: Node) -> bool:
        if n.name[0] == "#" or (self.name != "*" and self.name != n.name):
            return False
        for t in self.tests:
            if not _test(n, t):
                return False
        return True

    def attributed(self) -> bool:
        """Whether only elements with attributes match."""
        return any(t[0] in ("id", "class") or (t[0] == "attr" and (t[2] is None or t[3] is not None)) for t in self.tests)


_TOKEN = re.compile(
    r"\s*([>+~,])\s*|(\s+)|([A-Za-z_][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)"
    r"|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]"
    r"|:(not)\(|:(first-child|last-child|first-of-type|last-of-type|only-child|empty)|:(nth-child)\(\s*([^)]*)\)"
)


_OPERATORS = {
    "=": lambda got, want: got == want,
    "~=": lambda got, want: want in got.split() and bool(want),
    "|=": lambda got, want: got == want or got.startswith(want + "-"),
    "^=": lambda got, want: bool(want) and got.startswith(want),
    "$=": lambda got, want: bool(want) and got.endswith(want),
    "*=": lambda got, want: bool(want) and want in got,
}


def _position(n: Node, same: bool, last: bool) -> int:
    peers = [x for x in n.parent.elements() if not same or x.name == n.name] if n.parent else [n]
    k = next(i for i, x in enumerate(peers) if x is n) + 1
    return len(peers) - k + 1 if last else k


def _test(n: Node, t: tuple) -> bool:
    kind = t[0]
    if kind == "id":
        return n.attrs.get("id") == t[1]
    if kind == "class":
        return t[1] in n.classes()
    if kind == "attr":
        _, name, op, want = t
        got = n.attrs.get(name)
        return got is not None if got is None or op is None else _OPERATORS[op](got, want)
    if kind == "not":
        return not any(_chain(n, c) for c in t[1])
    if kind == "nth-child":
        a, b = t[1]
        k = _position(n, False, False) - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0
    if kind == "only-child":
        return _position(n, False, False) == 1 == _position(n, False, True)
    if kind == "empty":
        return not n.children
    return _position(n, kind.endswith("of-type"), kind.startswith("last")) == 1


def _nth(x: str) -> tuple[int, int]:
    x = x.replace(" ", "").lower()
    if x in ("odd", "even"):
        return 2, int(x == "odd")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", x)
    if not m or not x:
        raise SelectorError(f"nth-child({x})")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int(m[2] or 0)


@lru_cache(4096)
def compile_selector(selector: str) -> tuple:
    """A list of chains; a chain is ((combinator to the left, compound), ...)."""
    chains, at, end = _parse(selector.strip(), 0, top=True)
    if at != end or not chains:
        raise SelectorError(f"cannot read selector {selector!r}")
    return chains


def _parse(text: str, at: int, *, top: bool) -> tuple[tuple, int, int]:
    chains, chain, name, tests, comb = [], [], None, [], ""

    def flush() -> None:
        nonlocal name, tests, comb
        if name is None and not tests:
            raise SelectorError(f"empty part in {text!r}")
        chain.append((comb, Compound(name or "*", tuple(tests))))
        name, tests, comb = None, [], ""

    while at < len(text):
        if text[at] == ")" and not top:
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectorError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m[1] or m[2]:
            sign = m[1] or " "
            if not m[1] and (at >= len(text) or text[at] == ")"):
                continue
            if sign == ",":
                flush()
                chains.append(tuple(chain))
                chain = []
            elif name is None and not tests and not chain and sign == ">":
                name, comb = "*", ""
                chain.append(("", Compound("*")))
                name, comb = None, ">"
            else:
                flush()
                comb = sign
        elif m[3]:
            if name is not None:
                raise SelectorError(f"two names in {text!r}")
            name = m[3]
        elif m[4]:
            tests.append(("id", m[4]))
        elif m[5]:
            tests.append(("class", m[5]))
        elif m[6]:
            tests.append(("attr", m[6], m[7], next((x for x in m.group(8, 9, 10) if x is not None), None)))
        elif m[11]:
            inner, at, _ = _parse(text, at, top=False)
            if at >= len(text) or text[at] != ")":
                raise SelectorError(f"open :not in {text!r}")
            at += 1
            tests.append(("not", inner))
        elif m[12]:
            tests.append((m[12],))
        else:
            tests.append(("nth-child", _nth(m[14])))
    if chain or name is not None or tests:
        flush()
        chains.append(tuple(chain))
    return tuple(chains), at, len(text)


def _chain(n: Node, chain: tuple, k: int | None = None) -> bool:
    k = len(chain) - 1 if k is None else k
    comb, compound = chain[k]
    if not compound.matches(n):
        return False
    if k == 0:
        return True
    if comb == ">":
        return n.parent is not None and _chain(n.parent, chain, k - 1)
    if comb == " ":
        return any(_chain(a, chain, k - 1) for a in n.ancestors())
    peers = n.parent.elements() if n.parent else [n]
    i = next(j for j, x in enumerate(peers) if x is n)
    return (i > 0 and _chain(peers[i - 1], chain, k - 1)) if comb == "+" else any(_chain(x, chain, k - 1) for x in peers[:i])


@lru_cache(4096)
def _compiled(selector: str) -> tuple[tuple, bool]:
    """The chains, and whether all of them end in elements with attributes."""
    chains = compile_selector(selector)
    return chains, all(c[-1][1].attributed() for c in chains)


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of root that match, in document order."""
    chains, attributed = _compiled(selector)
    return [n for n in root.walk() if n is not root and (n.attrs or not attributed) and any(_chain(n, c) for c in chains)]


def first(root: Node, selector: str) -> Node | None:
    chains, attributed = _compiled(selector)
    return next((n for n in root.walk() if n is not root and (n.attrs or not attributed) and any(_chain(n, c) for c in chains)), None)
