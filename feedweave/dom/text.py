"""Visible text of a tree in document order."""

from __future__ import annotations

import re

from feedweave.dom.tree import Node
from feedweave.functions.lexicon import BLOCKS, INVISIBLE, SKIP_HREF

_SPACE = re.compile(r"[ \t\r\n\f\v]+")


def collapse(x: str) -> str:
    return _SPACE.sub(" ", x).strip()


def eligible_link(n: Node) -> bool:
    """An anchor with a target that is a page."""
    href = n.attrs.get("href", "").strip()
    return n.name == "a" and href != "" and not href.lower().startswith(SKIP_HREF)


def silent(n: Node) -> bool:
    """Elements whose text is not seen from outside: invisible ones and same-page anchors."""
    return n.name in INVISIBLE or (n.name == "a" and n.attrs.get("href", "").startswith("#"))


class _Text:
    """The text of one open element as it grows."""

    __slots__ = ("block", "children", "node", "parts")

    def __init__(self, node: Node) -> None:
        self.node, self.children, self.parts, self.block = node, iter(node.children), [], False

    def add(self, text: str, gap: str, *, block: bool) -> None:
        if text:
            if self.parts:
                self.parts.append(gap if block or self.block else " ")
            self.parts.append(text)
            self.block = block

    def joined(self) -> str:
        if len(self.parts) == 1:
            return self.parts[0].strip()
        return re.sub(" {2,}", " ", "".join(self.parts)).strip()


def visible_text(node: Node, exclude: tuple = (), separator: str = " ") -> str | None:
    """Text with line ends around blocks and ``- `` before list items; same-page anchors and invisible elements are left out.

    Open elements are kept in a list, so nesting of any depth is read; an only child's text is handed up as it is.
    """
    gap = "\n" if separator == " " else separator
    stack = [_Text(node)]
    while True:
        top = stack[-1]
        for c in top.children:
            if isinstance(c, str):
                top.add(collapse(c), gap, block=False)
            elif c.children and not silent(c) and not any(c is x for x in exclude):
                stack.append(_Text(c))
                break
        else:
            stack.pop()
            text = top.joined()
            if not stack:
                return text if top.parts else None
            if text and top.node.name == "li":
                text = f"- {text}"
            stack[-1].add(text, gap, block=top.node.name in BLOCKS)
