"""XPath paths against a plain walk of the tree; paging by them."""

import random

import pytest

from feedweave.dom.tree import parse
from feedweave.operators import paging, shred, xpath

PATHS = [
    "/html/body/div", "//a", "//div/a", "//div//a", "descendant::a", "//li[1]", "//li[last()]", "//ul/li[2]", "//a/..", "//a/parent::div", "//a/ancestor::div", "//b/ancestor-or-self::*", "//li/following-sibling::li[1]",
    "//li/preceding-sibling::li[1]", "//li[@class='x']/following-sibling::*", "//li/preceding-sibling::b", "//a[@href]", "//a[not(@href)]", "//a[@href='/1' or @class='x']", "//*[contains(@class, 'x') and not(@href)]",
    "//*[starts-with(@href, '/')]", "//a[text()='next']", "//a[contains(., 'ex')]", "//div[normalize-space()='next']", "//div[@class != 'x']", "//a | //b", "//div//li[1]//b", "//div/descendant-or-self::div", "//a/self::a/./b", "/descendant::a[2]", "//li[@class='x'][1]",
]


def random_markup(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "ul", "li", "b", "a"] if depth else ["div"])
        attrs = "".join(f' {k}="{v}"' for k, v in (("class", rng.choice(["x", "y x", ""])), ("href", rng.choice(["/1", "/2", "#"]))) if rng.random() < 0.5)
        text = rng.choice(["", "next", "text", " next "])
        inner = random_markup(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else ""
        out += f"<{tag}{attrs}>{text}{inner}</{tag}>"
    return out


class Plain:
    """Each step from each element by the definition of its axis."""

    def __init__(self, html):
        self.nodes = shred.numbered(parse(html))
        self.number = {id(n): i for i, n in enumerate(self.nodes)}
        r = shred.rows(1, parse(html))
        self.parent, self.last = r["parent_id"], r["last_desc"]

    def axis(self, at, axis):
        n = range(len(self.nodes))
        if at is None:
            return [i for i in n if self.parent[i] < 0] if axis == "child" else list(n) if axis.startswith("desc") else []
        own = [at] if axis.endswith("self") else []
        if axis == "child":
            return [i for i in n if self.parent[i] == at]
        if axis.startswith("desc"):
            return own + list(range(at + 1, self.last[at] + 1))
        if axis == "parent":
            return [self.parent[at]] if self.parent[at] >= 0 else []
        if axis.startswith("anc"):
            return own + [i for i in reversed(n) if i < at <= self.last[i]]
        if axis == "self":
            return own
        peers = [i for i in n if self.parent[i] == self.parent[at]]
        return [i for i in peers if i > at] if axis.startswith("foll") else [i for i in reversed(peers) if i < at]

    def value(self, i, t):
        node = self.nodes[i]
        if t[0] == "@":
            return node.attrs.get(t[1])
        if t[0] == "text":
            return t[1] if len(t) == 2 else "".join(c for c in node.children if isinstance(c, str))
        if t[0] == ".":
            return node.text()
        return " ".join((self.value(i, t[1]) if len(t) > 1 else node.text()).split())

    def holds(self, i, t):
        if t[0] in ("and", "or"):
            return (all if t[0] == "and" else any)(self.holds(i, x) for x in t[1:])
        if t[0] == "not":
            return not self.holds(i, t[1])
        if t[0] in ("=", "!=", "contains", "starts-with"):
            a, b = self.value(i, t[1]), self.value(i, t[2])
            if t[0] in ("=", "!="):
                return None not in (a, b) and (a == b) == (t[0] == "=")
            return (b or "") in (a or "") if t[0] == "contains" else (a or "").startswith(b or "")
        return self.value(i, t) is not None if t[0] == "@" else bool(self.value(i, t))

    def select(self, path):
        out = set()
        for steps, attribute in xpath.compile_path(path):
            found = [None]
            for s in steps:
                wide, axis = found, s.axis
                if s.loose:  # //name: children of every element below
                    wide = [x for at in found for x in ([None] if at is None else []) + self.axis(at, "descendant-or-self")]
                    axis = "child"
                new = set()
                for at in wide:
                    hits = [i for i in self.axis(at, axis) if s.name in ("*", self.nodes[i].name)]
                    for t in s.tests:
                        if t[0] == "at":
                            hits = hits[t[1] - 1 : t[1]]
                        elif t[0] == "last":
                            hits = hits[-1:]
                        else:
                            hits = [i for i in hits if self.holds(i, t)]
                    new |= set(hits)
                found = sorted(new)
            out |= {i for i in found if attribute is None or attribute in self.nodes[i].attrs}
        return out


def test_paths_on_random_trees(spark):
    rng = random.Random(3)
    pages = [(k, f"<body>{random_markup(rng)}</body>") for k in range(25)]
    nodes = shred.shred(spark.createDataFrame(pages, "page_id long, html string"), columns=xpath.NODES).cache()
    hits = 0
    for path in [*PATHS, "//li/@href", "//div[@class]/a/@href"]:
        got = {(r.page_id, r.node_id) for r in xpath.select(nodes, path).collect()}
        want = {(k, i) for k, html in pages for i in Plain(html).select(path)}
        assert got == want, path
        hits += len(want) > 0
    assert hits > 28
    nodes.unpersist()


@pytest.mark.parametrize("path", ["", "//", "//a[", "//a[2", "a::b", "//a[foo()]", "//a[position() < 3]", "//li/following-sibling::li[2]", "//div/descendant::a[1]", "//a/@href/b", "//a[contains(@x)]", "$x", "//ns:a"])
def test_what_is_not_read(path):
    with pytest.raises(xpath.XPathError):
        xpath.compile_path(path)


def test_crawl_by_xpath(spark):
    store = spark.createDataFrame([
        ("https://x.example/1", "<p class='n'> /2 </p><p class='n'>/9</p>"), ("https://x.example/1", "<p class='n'> /2 </p><!-- again -->"), ("https://x.example/2", "<a class='n' href='3'>go</a>"),
        ("https://x.example/3", "<a class='n' href=' '>/1</a>"), ("https://x.example/9", "<p>no</p>"),
    ], "url string, body string")
    start = spark.createDataFrame([(1, "https://x.example/1#top"), (2, "https://x.example/3"), (3, "https://x.example/9"), (4, "https://x.example/none")], "feed_id long, url string")
    for selector in ("//*[@class='n']", ".n"):
        got = paging.crawl(store, start, paging.by_selector(selector), 5).orderBy("feed_id", "page_no").collect()
        assert [(r.feed_id, r.page_no, r.url) for r in got] == [(1, 0, "https://x.example/1#top"), (1, 1, "https://x.example/2"), (1, 2, "https://x.example/3"), (2, 0, "https://x.example/3"), (3, 0, "https://x.example/9")]
