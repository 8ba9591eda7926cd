"""The walk from a bare heading or link to its card."""

import pytest

from feedweave.dom import css
from feedweave.dom.tree import parse
from feedweave.operators.extract import extract, main_anchor, parent_card

BASE = "https://shop.example/"


def taken(body, selector="h2"):
    item = css.first(parse(f"<body>{body}</body>"), selector)
    return extract(item, BASE, main_anchor(item))


def test_climbs_only_bare_headings_and_links():
    card = "<div><{0}><a href='/x'>A title of it</a></{0}><p>A real teaser.</p><time datetime='2024-01-02'>then</time></div>"
    assert taken(card.format("h2"))["description"] == "A real teaser." and taken(card.format("h2"))["published_at"] == "2024-01-02"
    assert taken(card.format("h2"), "a")["description"] == "A real teaser."
    assert taken(card.format("p"), "p")["description"] is None  # no heading and no link
    own = taken("<div><h2><a href='/x'>A title of it</a> with words</h2><p>A real teaser.</p></div>")
    assert own["description"] == "with words"
    dated = taken("<div><h2><a href='/x'>A title</a><time datetime='2024-01-02'>x</time></h2><p>Beside.</p></div>")
    assert dated["description"] is None and dated["published_at"] == "2024-01-02"
    told = taken("<div><a href='/x'><h3>A title</h3><p>Inside.</p></a><p>Beside.</p></div>", "a")
    assert told["description"] == "Inside."


@pytest.mark.parametrize(("body", "tag"), [
    ("<div id='c'><section><h2>t</h2></section><p>x</p></div>", "div"),
    ("<div><h2>t</h2></div>", None),
    ("<article><nav><h2>t</h2><p>x</p></nav><p>y</p></article>", "article"),
    ("<main><header><h2>t</h2><p>x</p></header></main>", None),
    ("<div><h2>t</h2><h3>u</h3></div>", None),
    ("<div><h2>t</h2><a href='/a'>a</a><a href='/b'>b</a></div>", None),
    ("<div><h2>t</h2><a href='/a'>a</a><a href='/a'>b</a><a href='#c'>c</a><a href='mailto:d'>d</a><a>e</a></div>", "div"),
])
def test_card(body, tag):
    card = parent_card(css.first(parse(f"<body>{body}</body>"), "h2"))
    assert (card.name if card is not None else None) == tag


def test_kicker_and_categories_of_the_card():
    got = taken("<div class='card'><span class='topic'>Energy</span><div><h2><a href='/x'>A title of it</a></h2></div><p>Text.</p><p>2024-03-05</p></div>")
    assert got["categories"] == ["Energy"] and got["published_at"] == "2024-03-05" and got["description"] == "Energy\nText."
