"""Operators against brute force, and on nulls, empty and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweave.llm import best_fit_packing, chat_perspectives, license_scan, lm_scoring, ogg_media, ppm, quality_rules, simhash_dedup, source_mixing, suffix_dedup, url_filters, word_tokens
from feedweave.llm.suffix_sort import suffix_array
from feedweave.llm.word_tokens import WordTokens

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, rows int, s string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls, empties, ties, repeated rows, one long text, columns whose names clash with inner ones."""
    rng = np.random.default_rng(3)
    body = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(80)) for _ in range(6)]
    long = " ".join(body * 8)
    rows = [(1, None, "a"), (2, "", "a"), (3, body[0], "a"), (3, body[0], "a"), (None, body[1], None), (5, body[0] + " tail", "b"), (6, body[2] + body[1], "b"), (7, long, "b"), (8, "é ü ñ 😀", None), (9, body[3], "c"), (10, body[4], "c"), (11, body[5], "c"), (12, " \n\t ", "c")]
    return [(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DDL)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(400):
        a = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 40)))
        a = np.tile(a[: max(1, len(a) // 3)], 4) if t % 3 == 0 and len(a) else a
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def removed(texts):
    seen = collections.Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    for x in texts:
        m = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        yield len(x), sum(m), sum(1 for i, v in enumerate(m) if v and not (i and m[i - 1])), hashlib.sha256(bytes(b for b, k in zip(x, m, strict=True) if not k)).hexdigest()


@pytest.mark.parametrize("hot", [2048, 3, 1])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    whole = suffix_dedup.resolve
    monkeypatch.setattr(suffix_dedup, "resolve", lambda found: whole(found, hot))  # small cores are split, too
    want = sorted(map(str, ((r[0], *x) for r, x in zip(odd_rows(), removed([(r[1] or "").encode() for r in odd_rows()]), strict=True))))
    assert sorted(str(tuple(r)) for r in suffix_dedup.digests(docs).collect()) == want
    assert suffix_dedup.digests(docs.limit(0)).count() == 0
    assert suffix_dedup.stage(spark, docs, SF).columns == docs.columns


def test_simhash(spark, docs):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash_dedup.classes(docs, 4).collect()]
    rows = [(r[0], simhash_dedup.simhash(r[1], 4)) for r in odd_rows()]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = [(rows[i][0], int(np.uint64(rows[i][1]).view(np.int64)), least[root[i]]) for i in range(len(rows))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash_dedup.classes(docs.limit(0), 4).count() == 0


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_rows():
    """Near copies of similarity 0.75 to 0.95, a chain of them, passages shared by unlike texts, a large group of copies."""
    rng = np.random.default_rng(11)

    def fresh(n):
        return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]

    def edited(words, n):
        out = list(words)
        for at in rng.choice(len(words), n, replace=False):
            out[at] = fresh(1)[0]
        return out

    texts, common = [], fresh(60)
    for k in range(24):
        base = fresh(300)
        texts += [base, edited(base, 1 + k % 9)]
        texts.append(edited(texts[-1], 5))
        texts.append(common + fresh(100))
    group = fresh(200)
    texts += [edited(group, int(n)) for n in rng.integers(0, 9, 60)]
    texts += [[], [], ["one"], ["One"], ["one", "two", "three"]]
    return [(i, " ".join(t), "en", "s", 0, 1, "x") for i, t in enumerate(texts)]


def similar_groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def test_near_dedup_stage_keeps_no_similar_pair(spark):
    rows = near_rows()
    groups = similar_groups([r[1] for r in rows])
    assert 40 < len(set(groups)) < len(rows) - 60
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    got = sorted(r.doc_id for r in simhash_dedup.stage(spark, docs, SF).collect())
    assert got == sorted(set(groups))
    assert simhash_dedup.stage(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(12)
    a, b, c, d = (" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(80)) for _ in range(4))
    texts = [(1, a), (1, a), (1, a), (None, a), (None, b), (None, b), (7, c), (None, c + " more"), (8, c + " more"), (None, d), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in texts], DDL).repartition(3)
    out = simhash_dedup.stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text or "") for r in out.collect())
    assert got == collections.Counter([(1, a), (None, b), (7, c), (None, d), (None, "")])
    left = collections.Counter((r.doc_id, r.text or "") for r in suffix_dedup.stage(spark, out, SF).collect())
    assert left - collections.Counter([(None, "")]) == got - collections.Counter([(None, "")])


def test_simhash_splits_large_keys(spark):
    rng = np.random.default_rng(4)
    low = rng.integers(0, 2**14, 3000, dtype=np.uint64)
    fps = np.unique(np.concatenate([low, low << np.uint64(40), rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    whole = simhash_dedup.forest(np.unique(fps), 4)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in simhash_dedup.edges(frame, len(fps), bucket=40).collect()]
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        x, y = sorted((top(x), top(y)))
        root[y] = x
    want = {int(y): int(x) for x, y in zip(whole[0].view(np.int64), whole[1].view(np.int64), strict=True)}
    groups = {}
    for x in root:
        groups.setdefault(want.get(x, x), set()).add(top(x))
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len({top(x) for x in root})


def test_simhash_plan_keeps_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    for n in (100, 10**6, 10**10):
        plan = simhash_dedup.plan(fps, n, 4)
        assert sum(t for _, t in plan) >= 4 - len(plan) + 1
        part, key, fp = simhash_dedup.keys(fps, plan)
        at = collections.defaultdict(set)
        for p, k, f in zip(part.tolist(), key.tolist(), fp.tolist(), strict=True):
            at[p, k].add(f)
        met = {(a, b) for v in at.values() if len(v) > 1 for a in v for b in v if a < b and (a ^ b).bit_count() <= 4}
        assert met == {(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 4}


def test_mixing(docs):
    rows = source_mixing.per_row(source_mixing.copies(source_mixing.sized_documents(docs).select(*source_mixing.KEY))).collect()
    again = source_mixing.per_row(source_mixing.copies(source_mixing.sized_documents(docs).select(*source_mixing.KEY))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(odd_rows())
    size, target, taken, most = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in rows:
        assert 0 <= r["_copies"] <= 2
        size[r["_s"]] += r["_n"]
        target[r["_s"]] = r["target"]
        taken[r["_s"]] += r["_copies"] * r["_n"]
        most[r["_s"]] = max(most[r["_s"]], r["_n"])
    total = sum(size.values())
    weights = dict(zip(sorted(x for x in size if x is not None), (3, 1, 2), strict=False)) | {None: 3}
    want, free, left = {}, dict(weights), 1.5 * total
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level >= 2 * size[s]]
        for s in over or list(free):
            want[s] = 2 * size[s] if over else free[s] * level
            left -= want[s]
            del free[s]
    for s in size:
        assert math.isclose(target[s], want[s], abs_tol=1e-6)
        assert abs(taken[s] - target[s]) <= most[s]
    assert source_mixing.mix(docs).count() == sum(r["_copies"] for r in rows)
    assert source_mixing.mix(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    got = best_fit_packing.packed_documents(docs).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 2048
    lib = WordTokens(best_fit_packing.tokenizer_path()).lib
    want = collections.Counter()
    for r in odd_rows():
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert best_fit_packing.packed_documents(docs.limit(0)).count() == 0


def test_tokens_equal_the_unaltered_library():
    from tokenizers import Tokenizer

    path = best_fit_packing.tokenizer_path()
    lib = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|startoftext|>", "a<|endoftext|>b c", "x <|ENDOFTEXT|> y", "<|endoftext|", "t\u2003<|endoftext|>", "\x1c <|startoftext|>\n", "é <|endoftext|>", "plain", "", "😀 ﬁ <|endoftext|><|endoftext|>"]
    assert [x.tolist() for x in WordTokens(path)(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert WordTokens(path)(texts[:1])[0].tolist() == [637, 49407, 1237]


def test_latin_words_equal_the_library_and_are_merged_once(monkeypatch):
    path = best_fit_packing.tokenizer_path()
    w, rng = WordTokens(path), np.random.default_rng(8)
    merged, merge = [], w.merge
    monkeypatch.setattr(w, "merge", lambda *a: (lambda got: (merged.append(len(got[1])), got)[1])(merge(*a)))
    for text in ("stone", "Stone.", "STONE!! (stone)", "stone's stone,"):
        assert w([text])[0].tolist() == w.lib.encode(text, add_special_tokens=False).ids
    assert sum(merged) == 7  # stone . !! ( ) 's and the comma
    signs = [chr(c) for c in range(1, 256)]
    near = list("aeStTdDmMrRvVlL''\u00c9\u00e9\u00df\u00b2\u00bd1.- \n")
    made = ["".join(rng.choice(near if k % 3 else signs, int(rng.integers(0, 60)))) for k in range(3000)]
    made += ["a" * n + "\u00e9" * m for n in range(14, 19) for m in range(4)]
    made += ["", "'", "x'", "it's'll''re've'S'D 5's", "\0", "a\0 a\0\0 a", "a\u0153 b", "a\u2019s b"]
    want = [x.ids for x in w.exact.encode_batch(made, add_special_tokens=False)]
    monkeypatch.setattr(word_tokens, "STEP", 7)
    for words in (10**6, 50):  # the table kept, and emptied before each batch
        monkeypatch.setattr(word_tokens, "WORDS", words)
        assert [x.tolist() for k in range(0, len(made), 500) for x in w(made[k : k + 500])] == want


def test_word_table_grows():
    rng, t, known = np.random.default_rng(9), word_tokens.WordTable(2), {}
    for _ in range(30):
        first, second = rng.integers(0, 40, 200).astype(np.uint64), rng.integers(0, 40, 200).astype(np.uint64)
        words = list(zip(first.tolist(), second.tolist(), strict=True))
        assert t.find(first, second).tolist() == [known.get(x, -1) for x in words]
        number, fresh = t.add(first, second)
        known |= {words[k]: n for n, k in enumerate(fresh.tolist(), len(known))}
        assert t.n == len(known) == len(set(known.values())) and number.tolist() == [known[x] for x in words]


def test_packing_numbers_of_large_tasks_do_not_meet(spark):
    docs = spark.range(0, 2_000_200, 1, 2).selectExpr("id as doc_id", "'' as text")
    r = best_fit_packing.pieces(docs, best_fit_packing.tokenizer_path()).selectExpr("count(*) as n", "count(distinct deal) as deals").first()
    assert (r.n, r.deals) == (2_000_200, 2_000_200)


def squares(gaps):
    return sum(n * n for g, n in collections.Counter(gaps).items() if 0 < g < 40)


def test_packing_rule_equals_brute_force():
    rng = np.random.default_rng(6)
    for t in range(60):
        lengths = rng.integers(1, 41, int(rng.integers(1, 40)))
        filled = rng.integers(1, 41, int(rng.integers(0, 6)))
        where, used = best_fit_packing.sum_of_squares(lengths, 40, filled)
        assert (used == np.concatenate([filled, np.zeros(len(used) - len(filled), int)]) + np.bincount(where, lengths, len(used)).astype(int)).all() and used.max() <= 40
        gaps = (40 - filled).tolist()
        for size, bin_ in zip(lengths.tolist(), where.tolist(), strict=True):
            choices = {}
            for g in sorted({x for x in gaps if x >= size}):
                after = list(gaps)
                after[after.index(g)] = g - size
                choices[g] = squares(after)
            new = squares([*gaps, 40 - size])
            best = min(choices.values(), default=None)
            if best is not None and best <= new:
                want = min(g for g, v in choices.items() if v == best)
                assert bin_ < len(gaps) and gaps[bin_] == want
                gaps[bin_] -= size
            else:
                assert bin_ == len(gaps)
                gaps.append(40 - size)


def test_reopened_bins_follow_the_rule():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 41, int(rng.integers(1, 80))))[::-1]
        where, used = best_fit_packing.sum_of_squares(lengths, 40)
        bins = [[n for n, b in zip(lengths.tolist(), where.tolist(), strict=True) if b == k] for k in range(len(used))]
        for r in range(best_fit_packing.REOPEN):  # the same rounds on lists of pieces
            order = sorted(range(len(bins)), key=lambda k: sum(bins[k]))
            poor = [k for k in order[: max(1, len(bins) // (10 if r % 2 else 5))] if sum(bins[k]) < 40]
            kept = [b for k, b in enumerate(bins) if k not in poor]
            pieces = sorted((n for k in poor for n in bins[k]), reverse=True)
            placed, full = best_fit_packing.sum_of_squares(np.array(pieces, int), 40, np.array([sum(b) for b in kept], int))
            if not pieces or len(full) > len(bins):
                break
            bins = [list(b) for b in kept] + [[] for _ in range(len(full) - len(kept))]
            for n, b in zip(pieces, placed.tolist(), strict=True):
                bins[b].append(n)
        where, offset = best_fit_packing.reopened(lengths, 40)
        assert sorted(sorted(lengths[where == k].tolist()) for k in set(where.tolist())) == sorted(map(sorted, bins))
        for k in set(where.tolist()):
            rows = sorted(zip(offset[where == k].tolist(), lengths[where == k].tolist(), strict=True))
            assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False)) and sum(rows[-1]) <= 40


def test_packing_needs_few_sequences(spark):
    got = best_fit_packing.op5_best_fit_packing(spark, "/root/testdata/sf0.01").selectExpr("count(distinct sequence_id) as n", "ceil(sum(length) / 2048) as least").first()
    assert got.n <= got.least + 2


def test_packing_rounds(spark):
    table = spark.range(3000).selectExpr("id as deal", "1 + pmod(xxhash64(id), 2048) as length")
    out = best_fit_packing.pack(table, 3000, group=20).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(out) == 3000
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 2048


def trie_logs(train, text, order=5, own=6):
    """Log10 probability of text by counting tries in dictionaries, byte by byte."""
    trie = collections.defaultdict(collections.Counter)
    for t in train:
        t = b"\xff" * order + t + b"\xff"
        for i in range(order, len(t)):
            for k in range(order + 1):
                trie[t[i - k : i]][t[i]] += 1
    shown = collections.defaultdict(collections.Counter)
    text, total = b"\xff" * own + text + b"\xff", 0.0
    for i in range(own, len(text)):
        gone, p, byte = set(), 1.0, text[i]
        for k in range(order, -1, -1):
            left = {x: n for x, n in trie[text[i - k : i]].items() if x not in gone}
            if not left:
                continue
            if byte in left:
                p *= (left[byte] - 0.5) / sum(left.values())
                break
            p *= len(left) / (2 * sum(left.values()))
            gone |= set(left)
        else:
            p /= 256 - len(gone)
        have = shown[text[i - own : i]]
        if have:
            p = (max(have[byte] - 0.5, 0) + (len(have) / 2 + 1) * p) / (sum(have.values()) + 1)
        have[byte] += 1
        total += math.log10(p)
    return total


@pytest.mark.parametrize("block", [12_000_000, 900])
def test_lm(docs, monkeypatch, block):
    rows = odd_rows()
    train = [(r[1] or "").encode() for r in rows if not lm_scoring.held_out(r[0])]
    c = collections.Counter(w for t in train for w in [*t.lower().split(), "end"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), "end"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[r[0], lm_scoring.held_out(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(trie_logs(train, (r[1] or "").encode()), 1)] += 1
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 1)) for r in lm_scoring.score(docs).collect())
    assert got == want
    assert lm_scoring.score(docs.limit(0)).count() == 0
    assert all(r.train_tokens == 0 for r in lm_scoring.score(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect())


def test_ppm_sums_to_one():
    text = [b"the cat sat on the mat", b"abracadabra", "été naïve".encode()]
    model = ppm.Model(ppm.lower_orders(*ppm.count(ppm.spread(text)[0]), ppm.ORDER))
    for ctx in (b"\xff" * 5, b"e cat", b"zzzzz", b"abrac", b"zz th"):
        key = 0
        for b in ctx:
            key = key << 8 | b
        assert math.isclose((10 ** model.code(np.int64(key << 8) + np.arange(256))).sum(), 1, abs_tol=1e-5)


def test_ogg():
    for payload in (b"\0" * 64, bytes(range(256)) * 300, b"x" * 64000, bytes(np.random.default_rng(0).integers(0, 256, 400_000, dtype=np.uint8))):
        media = ogg_media.mux(payload)
        got, rate, streams = ogg_media.read_pcm(media)
        assert (got, rate, len(streams)) == (payload, 8000, 2)
        for s in streams.values():
            sizes = [0, *map(len, s.packets[1:])]
            assert s.ends == np.cumsum(sizes).tolist()
        bad = bytearray(media)
        bad[len(media) // 2] ^= 1
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(bytes(bad))
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(media[:-3])
    long = streams[1]
    assert max(map(len, long.packets)) > 65_025 and long.pages < len(long.packets) * 2 and len(long.page_ends) < len(long.packets)
    crc = 0
    for b in b"OggS-check":
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg_media.page_crc(b"OggS-check") == crc
    long = ogg_media._Writer(9)
    data = b"".join([*long.pages(b"h", 0, flush=True), *long.pages(b"y" * 70000, 5, last=True)])
    assert [len(p) for p in ogg_media.demux(data)[9].packets] == [1, 70000]
    with pytest.raises(ogg_media.OggError):  # a position, but no packet ends
        ogg_media.demux(ogg_media._page(2, 7, 3, 0, b"\xff", b"a" * 255) + ogg_media._page(5, 7, 3, 1, b"\1", b"b"))


def test_ogg_counts_back_within_a_page():
    head = ogg_media.PCM_HEAD.pack(b"PCM     ", 0, 0, 1, 8000, 8, 1, 1, 0)
    pages = [ogg_media._page(2, 0, 4, 0, bytes([len(head)]), head), ogg_media._page(0, 30, 4, 1, bytes([10, 20]), b"a" * 30), ogg_media._page(4, 75, 4, 2, bytes([40, 10]), b"b" * 50)]
    s = ogg_media.demux(b"".join(pages))[4]
    assert s.ends == [0, 10, 30, 70, 75] and len(ogg_media.samples_of(s)) == 75  # the last page cuts five samples


def pages_of(serial, packets):
    """A page for each group of (packet, granule of the page)."""
    out = []
    for k, (group, granule) in enumerate(packets):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in group)
        out.append(ogg_media._page((2 if not k else 0) | (4 if k + 1 == len(packets) else 0), granule, serial, k, lacing, b"".join(group)))
    return b"".join(out)


def test_ogg_times_by_the_streams_own_rate(spark):
    pcm = ogg_media.mux(bytes(32_000), 16_000)
    opus_head = b"OpusHead" + bytes([1, 2]) + (312).to_bytes(2, "little") + (44_100).to_bytes(4, "little") + bytes(3)
    frames = [bytes([31 << 3]) + b"a", bytes([31 << 3 | 1]) + b"bb", bytes([3 << 3 | 3, 2]) + b"cc", bytes([12 << 3]) + b"d"]  # 20, 40, 120 and 10 ms
    assert [ogg_media.opus_length(p) for p in frames] == [960, 1920, 5760, 480] and ogg_media.opus_length(b"") == 0
    opus = pages_of(5, [([opus_head], 0), ([b"OpusTags"], 0), (frames[:2], 2880), (frames[2:], 9000)])  # the end cuts 120 samples
    late = pages_of(6, [([opus_head], 0), ([b"OpusTags"], 0), (frames[:2], 102_880), (frames[2:3], 108_640)])  # cut out of a longer stream
    vorbis = pages_of(7, [([b"\x01vorbis" + bytes(4) + b"\2" + (44_100).to_bytes(4, "little") + bytes(14)], 0), ([b"x", b"y"], 22_050)])
    other = pages_of(8, [([b"\x80theora"], 0), ([b"x"], 64)])
    media = spark.createDataFrame([(1, pcm), (2, opus), (3, late), (4, vorbis), (5, other)], "id long, m binary")
    got = collections.defaultdict(list)
    for r in ogg_media.packets(media, "m", "id").orderBy("key", "serial", "packet").collect():
        got[r.key, r.serial].append((r.granule, r.seconds))
        assert r.error is None
    assert got[1, 1][-1] == got[1, 2][-1] == (16_000, 1.0)
    assert [g for g, _ in got[2, 5]] == [0, 0, 960, 2880, 8640, 9000] and got[2, 5][2][1] == (960 - 312) / 48_000 and got[2, 5][0][1] == 0
    assert [g for g, _ in got[3, 6]] == [0, 0, 100_960, 102_880, 108_640]
    assert got[4, 7] == [(0, 0), (-1, None), (22_050, 0.5)] and got[5, 8] == [(0, None), (64, None)]
    gap = pages_of(5, [([opus_head], 0), ([b"OpusTags"], 0), (frames[:1], 960), (frames[1:2], 9000), (frames[2:3], 14_760)])
    with pytest.raises(ogg_media.OggError):
        ogg_media.demux(gap)


def test_ogg_rows(spark, docs):
    rows = docs.select("doc_id", "text").mapInArrow(ogg_media._digest, ogg_media.OUT_DDL).collect()
    want = collections.Counter()
    for i, text, *_ in odd_rows():
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64) if raw else bytes(64)
        media = ogg_media.mux(payload)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:7] for r in rows) == want
    assert docs.limit(0).select("doc_id", "text").mapInArrow(ogg_media._digest, ogg_media.OUT_DDL).count() == 0
    media = ogg_media.store(docs.select("doc_id", "text"))
    got = ogg_media.packets(media, "media", "doc_id").where("error is null")
    assert got.where("seconds is null").count() == 0
    ends = {(r.key, r.serial): r.end for r in got.where("key = 7").groupBy("key", "serial").agg({"granule": "max"}).withColumnRenamed("max(granule)", "end").collect()}
    size = len(odd_rows()[7][1].encode())
    assert ends == {(7, k): (size + (-size) % 64) // 2 for k in (1, 2)}
    broken = spark.createDataFrame([(1, b"nothing"), (2, None)], "id long, m binary")
    assert [(r.key, r.error) for r in ogg_media.packets(broken, "m", "id").collect()] == [(1, "no page at byte 0")]


def test_quality(spark, docs):
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "# a |b\n# a |b\n$$ <>")], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality_rules.annotate(extra, []).collect()}
    for i, text, *_ in [*odd_rows(), (20, "# a |b\n# a |b\n$$ <>")]:
        w = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for p in range(len(w) - 2) if grams[w[p], w[p + 1], w[p + 2]] > 1 for k in (p, p + 1, p + 2)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_decision_list():
    rng = np.random.default_rng(2)
    rows = [{f: float(x) for f, x in zip(quality_rules.FEATURES, rng.random(7), strict=True)} for _ in range(900)]
    for r in rows:
        r["bad"] = int(r["symbols_per_word"] > 0.8 or (r["upper_share"] > 0.7 and r["mean_word"] <= 0.3))
    rules = quality_rules.learn(rows)
    wrong = sum(any(x.holds(r) for x in rules) != bool(r["bad"]) for r in rows)
    assert len(rules) >= 2 and wrong <= 30
    assert quality_rules.learn([r | {"bad": 0} for r in rows]) == []


def test_quality_verdict_and_clashes(spark, docs):
    rules = [quality_rules.Rule([("mean_word", "<=", 4.9)]), quality_rules.Rule([("n_words", ">", 200.0), ("repeat_share", "<=", 0.9)])]
    df = docs.withColumnRenamed("n_chars", "n_words").withColumnRenamed("s", "_f").withColumnRenamed("rows", "_s")
    out = quality_rules.annotate(df, rules)
    assert out.columns == ["doc_id", "text", "lang", "source", "_s", "_f", *quality_rules.RESULTS]
    for r in out.collect():
        w = WORDS.findall(r.text or "")
        mean = sum(map(len, w)) / max(1, len(w))
        rejected = mean <= 4.9 or (len(w) > 200 and r.n_repeat_words / max(1, len(w)) <= 0.9)
        assert (r.kept, r._f, r._s) == (not r.base_failed and not rejected, "x", 1)
    assert quality_rules.annotate(df.limit(0), rules).count() == 0
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "doc_id string, quality int")
    texts = spark.createDataFrame([("a", "x " * 60), ("b", "y"), (None, None)], "doc_id string, text string")
    assert quality_rules.fit(texts, labels) == [] and quality_rules.fit(texts, labels.limit(0)) == []


def test_queries_equal_sql(spark):
    c = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for query, sql in ((license_scan.op3_license_scan, license_scan.oracle()), (url_filters.op6_url_filters, url_filters.oracle()), (chat_perspectives.op8_chat_perspectives, chat_perspectives.ORACLE)):
        cur = c.execute(sql)
        cols = [x[0] for x in cur.description]
        want = sorted(str([r[k] for k in sorted(r)]) for r in (dict(zip(cols, x, strict=True)) for x in cur.fetchall()))
        assert sorted(str([r[k] for k in sorted(r)]) for r in (x.asDict() for x in query(spark, SF).collect())) == want


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no-scheme", "h"), (3, "http://A.Example.COM/en/7?x", "h"), (4, "x://b.net/de/", "h"), (4, "x://b.net/de/", "h"), (5, "http://notexample.community/en/7", "h"), (6, "http://h.com/" + "a/" * 5000 + "login", "h")], "page_id long, url string, host string")
    out = url_filters.judge(pages, url_filters.default_rules())
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id, r.host, r.path[:20], r.rule, r.verdict) for r in out.collect())
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7", "example.com/en/7", "allow"), (4, "b.net", "/de/", "net/de/", "block"), (4, "b.net", "/de/", "net/de/", "block"), (5, "notexample.community", "/en/7", None, "allow"), (6, "h.com", "/a/a/a/a/a/a/a/a/a/a", None, "block")]
    anywhere = url_filters.UrlRule("digits", "block", "[0-9]$", (), 5)
    assert {r.page_id: r.rule for r in url_filters.judge(pages, [anywhere]).collect()} == {1: None, 2: None, 3: "digits", 4: None, 5: "digits", 6: None}
    assert {r.verdict for r in url_filters.judge(pages, []).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), [anywhere]).count() == 0


def test_url_verdicts_of_the_contract(spark, tmp_path):
    want = [
        ("http://a.com/en/x", "com/en/", "block"),
        ("http://Example.com/en/7x", "example.com/en/7", "allow"),
        ("http://sub.example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/x", "net/de/", "allow"),
        ("x://net/de/login", "net/de/", "allow"),
        ("http://example.net/de/7", "net/de/", "allow"),
        ("http://b.example.net/de/80?q", "example.net/de/8", "block"),
        ("http://a.org/es/#x", "org/es/", "block"),
        ("http://anet/de/", None, "allow"),
        ("http://a.net/de", None, "allow"),
    ]
    spark.createDataFrame([(k, url) for k, (url, _, _) in enumerate(want)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.op6_url_filters(spark, str(tmp_path)).collect()}
    assert got == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(want)}


def test_url_rule_files(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# a list\nblock com/en/\n\nallow example.com/en/7  # keep\n")
    assert url_filters.read_rules(spark, str(tmp_path / "rules.txt")) == [url_filters.host_rule("com/en/", "block"), url_filters.host_rule("example.com/en/7", "allow")]


def test_chat_renders_whole_dialogues(spark):
    rows = [(1, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(600)] + [(1, 3, "ann", "turn 3"), (1, None, None, None), (None, None, "bob", "x"), (2, 0, "system", "only"), (3, 0, "system", "s"), (3, 1, "ann", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat_perspectives.render(turns)
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r.conv_id, r.speaker].append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, "ann"): 3, (1, "bob"): 3, (1, "unknown"): 3, (None, "bob"): 1, (3, "ann"): 1}
    ordered = sorted(((c, -1 if t is None else t, r or "unknown", x or "") for c, t, r, x in rows if c == 1))
    for who in ("ann", "bob", "unknown"):
        text, mask = "", []
        for _, _, role, said in ordered:
            text += f"<|{'assistant' if role == who else 'user:' + role}|>\n"
            if role == who:
                mask.append((len(text), len(text) + len(said)))
            text += said + "<|end|>\n"
        pieces = sorted(by[1, who], key=lambda r: r.part)
        assert "".join(r.text for r in pieces) == text and [tuple(m) for r in pieces for m in r.mask] == mask
        assert [r.start for r in pieces] == [0, len(pieces[0].text), len(pieces[0].text) + len(pieces[1].text)]
    assert {(r.conv_id, r.speaker): r.text for r in chat_perspectives.dialogues(out).collect()}[3, "ann"] == "<|system|>\ns<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat_perspectives.render(turns.limit(0)).count() == 0


def test_license_rules(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    rows = [(1, "Released under the MIT License.", 9), (2, gpl, 9), (3, None, 9), (4, "", 9), (5, gpl + "\n" + gpl, 9), (5, "Licensed under the ISC License. Unknown. Licensed under the ISC License.", 9), (6, "word. " * 20000 + "Licensed under CC0-1.0.", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ids int")
    got = [(r.doc_id, r.licenses, r.sentence_ids.count(" ") + 1 if r.sentence_ids else 0) for r in license_scan.scan(df).collect()]
    assert sorted(got) == [(1, "MIT", 1), (2, "GPL-3.0-or-later", 3), (3, "", 0), (4, "", 0), (5, "GPL-3.0-or-later", 6), (5, "ISC", 2), (6, "CC0-1.0", 1)]
    assert license_scan.scan(df).columns == ["doc_id", "text", "_ids", "n_sentences", "sentence_ids", "licenses"]
    assert license_scan.scan(df.limit(0)).count() == 0 and len({v for v, _ in license_scan.RULES}) >= 35


def licences(ids):
    """Rules one after another over a plain list of identifiers."""
    rest, found = list(ids), []
    for name, rule in license_scan.RULES:
        k, hit = 0, False
        while k + len(rule) <= len(rest):
            if tuple(rest[k : k + len(rule)]) == rule:
                rest[k : k + len(rule)] = ["-"]
                hit = True
            k += 1
        if hit and name not in found:
            found.append(name)
    return ",".join(found)


def test_license_rules_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    known = sorted(license_scan.SENTENCES)
    rows = []
    for k in range(120):
        picked = [known[i] for i in rng.integers(0, len(known), int(rng.integers(0, 12)))]
        name, rule = license_scan.RULES[int(rng.integers(0, len(license_scan.RULES)))]
        whole = [next(s for s, v in license_scan.SENTENCES.items() if v == x) for x in rule]
        rows.append((k, ". ".join([*picked, *whole * int(rng.integers(0, 3)), "no such sentence", *picked[:2]]) + "."))
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        ids = [license_scan.SENTENCES.get(x.strip(" .")) for x in r.text.split(". ")]
        assert r.licenses == licences([x or "-" for x in ids])


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    shared = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(60))
    rows = [r for r in near_rows()[:24]] + [(100, None, "en", None, 0, 1, "x"), (101, "", "en", "b", 0, 1, "x"), (102, "few words", "en", "b", 0, 1, "x"), (103, "same same same " * 40, "en", "b", 0, 1, "x")]
    for k in (200, 201):
        rows.append((k, " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(90)) + " " + shared, "en", "c", 0, 1, "x"))
    rows += [rows[0], (None, *rows[0][1:]), (None, " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(90)), "en", None, 0, 1, "x")]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        outs.append(docs)
    for out in outs[:-1]:
        assert out.columns == [x.split()[0] for x in DDL.split(", ")]

    def passes(text):
        w = WORDS.findall(text or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for p in range(len(w) - 2) if grams[w[p], w[p + 1], w[p + 2]] > 1 for k in (p, p + 1, p + 2)}
        return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)

    left = [r for r in rows if passes(r[1])]
    assert collections.Counter(tuple(r) for r in outs[0].collect()) == collections.Counter(left) and 0 < len(left) < len(rows)
    groups = similar_groups([r[1] for r in left])
    first = [min((r for r, g in zip(left, groups, strict=True) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in sorted(set(groups))]
    assert sorted(str(r[0]) for r in outs[1].collect()) == sorted(str(r[0]) for r in first)
    texts = [r.text for r in outs[1].collect()]
    want = {t: x for t, x in zip(texts, removed([t.encode() for t in texts]), strict=True)}
    by_id = {r.doc_id: r.text for r in outs[1].collect()}
    for r in outs[2].collect():
        kept = hashlib.sha256(r.text.encode()).hexdigest()
        assert kept == want[by_id[r.doc_id]][3] and r.n_chars == len(r.text)
    assert outs[2].count() == sum(x[1] < x[0] for x in want.values())
    sizes = collections.Counter()
    for r in outs[2].collect():
        sizes[r.source] += len(WORDS.findall(r.text))
    taken, copies = collections.Counter(), collections.Counter()
    for r in outs[3].collect():
        taken[r.source] += len(WORDS.findall(r.text))
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2 and all(taken[s] <= 2 * sizes[s] for s in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 300 * len(sizes)
    bins = collections.defaultdict(list)
    for r in outs[4].collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 2048
    assert collections.Counter(r.doc_id for r in outs[4].where("piece = 0").collect()) == copies


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0


def test_mixing_of_any_names_ids_and_repeats(spark):
    rows = [(f"id {i % 40}", "word " * (3 + i % 50), "abc"[i % 3], i % 7, "x") for i in range(120)] + [(None, "same words here", "a", 1, "y")] * 2000
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, _rows long, _n string").withColumns({"_total": F.lit(1), "_id": F.lit("z"), "_in3": F.lit(2)})
    got = source_mixing.mix(docs)
    assert got.columns == docs.columns
    assert got.join(docs, docs.columns, "left_anti").count() <= got.where("doc_id is null").count()  # null ids do not join
    sizes = {s: sum(len(t.split()) for _, t, x, *_ in rows if x == s) for s in "abc"}
    taken = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    want = {r._s: r.target for r in source_mixing.copies(source_mixing.sized_documents(docs.select("doc_id", "text", "source")).select(*source_mixing.KEY)).select("_s", "target").distinct().collect()}
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)


def test_fit_gathers_one_row_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda rows, *_: seen.append(rows) or [])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "s")] * 3000 + [(2, text + " z", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    quality_rules.fit(docs, labels)
    assert sorted((r["id"], r["bad"]) for r in seen[0]) == [(1, 1), (2, 0)]
