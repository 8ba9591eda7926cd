"""Spelling variants and the conversation trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from feedweave.llm import conversation_trie, spelling_variants

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(map(str, out))


def variant_rows():
    rng = random.Random(2)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["shared" + "".join(rng.choice("xy") for _ in range(5)) for _ in range(30)]
    words = []
    for s in stems:
        i = rng.randrange(len(s))
        words += [s, s[:i] + s[i + 1 :], s[:i] + rng.choice("abz") + s[i:], s[:i] + rng.choice("abz×") + s[i + 1 :]]
    rows = [(k, " ".join(rng.choices(words, k=60)).title()) for k in range(60)]
    return [*rows, (1, None), (2, ""), (None, " ".join(words[:30])), *rows[:5], (7, "e" * 3000 + " " + "e" * 2999), (8, "e" * 3000), (9, "e" * 3000 + " " + "e" * 2999), (10, "e" * 2999)]


@pytest.mark.parametrize("limit", [spelling_variants.LIMIT, 4, 1])
def test_variants(spark, limit):
    rows = variant_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = sorted(str(tuple(r)) for r in spelling_variants.variants(docs, limit=limit).collect())
    assert got == brute_variants(rows)
    assert sum("None" not in x for x in got) > 20
    assert spelling_variants.variants(docs.limit(0), limit=limit).count() == 0


def test_long_texts_are_read_run_by_run(monkeypatch):
    text = "AbÉd, x " * 50
    whole = spelling_variants.runs_of(text)
    monkeypatch.setattr(spelling_variants, "LONG_TEXT", 1)
    assert spelling_variants.runs_of(text) == whole and whole["abÉd"] == 50


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        built[c] = (own.get(c - c % 100, []) if h else [])[:h] + turns[h:]
    nodes, kids = collections.defaultdict(list), collections.Counter()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in nodes:
        kids[k[:-1]] += bool(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    least = {k: min((c for c in m if c is not None), default=None) for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        ends = sorted(c for c in m if c is not None and len(built[c]) == len(k))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def trie_rows():
    rng = random.Random(4)
    texts = ["", "hello", "hé \U0001f600", "a" * 70 + "1", "a" * 70 + "2", None]
    rows = []
    for c in [*range(0, 12), *range(100, 160), *range(205, 215), 1000, None]:
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), texts[rng.randrange(3)]))
    rows += [(100, t, "user", f"turn {t}") for t in range(3)] + rows[:9]  # repeated rows
    rows += [(300, None, "user", texts[3]), (300, None, "user", texts[4]), (300, 1, None, None), (301, 0, "", "")]
    rows += [(302, t, "user", "same") for t in range(70)] + [(303, t, "user", "same") for t in range(50)]
    return rows


@pytest.mark.parametrize(("piece", "fan", "block"), [(4096, 256, 512), (3, 2, 2)])
def test_trie(spark, piece, fan, block):
    rows = trie_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, ka string").repartition(7)
    assert sorted(str(tuple(r)) for r in conversation_trie.digests(table, piece, fan, block).collect()) == brute_trie(rows)
    assert conversation_trie.digests(table.limit(0), piece, fan, block).count() == 0


def test_trie_as_it_is(spark):
    """Node texts and end blocks of conversations that nothing is grafted onto."""
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "c"), (4, 0, "user", "a"), (4, 1, "bot", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, blocks = conversation_trie.trie(table)
    got = conversation_trie.with_turns(nodes, table).select("least", "depth", "role", "text", "members", "n_leaves", "saved").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, None, None, 4, 2, 3), (1, 1, "user", "a", 3, 1, 3), (1, 2, "bot", "b", 2, 1, 1), (3, 1, "user", "c", 1, 1, 0)]))
    assert sorted(list(r.ids) for r in blocks.select("ids").collect()) == [[1, 4], [2], [3]]
