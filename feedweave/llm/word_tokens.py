"""Token ids of whole texts for a word-BPE tokenizer file, by caches of words and of white-space separated chunks.

Texts of Latin-1 characters are cut into the tokenizer's words with vector operations over all their characters at once; a
table of words, compared whole, gives the ids, and new words are merged all at once. For other texts: the tokenizer never
looks across white space, so a text's ids are the ids of its chunks. Each worker keeps a bounded cache of chunks; new chunks
of Latin letters and ASCII signs are merged all at once, others, and texts with other white space than blanks, tabs and line
ends, go through the library. Texts that may hold an added token (it is found before chunks are) go through the library as a
whole. Equal to the library's ids (tested).
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

CACHE = 300_000  # chunks
WORDS = 1_000_000  # words of Latin-1 texts
STEP = 65_536  # words that enter the table at a time
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, others follow 255."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class PairTable:
    """Merge ranks and results by pair, two probes a lookup (cuckoo hashing)."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, ids: np.ndarray, bits: int = 17) -> None:
        self.shift = np.uint64(64 - bits)
        self.mult = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
        slots: list[list[int]] = [[-1] * (1 << bits), [-1] * (1 << bits)]
        where = [((pairs.astype(np.uint64) * m) >> self.shift).astype(np.int64).tolist() for m in self.mult]
        for k in range(len(pairs)):
            side, at = 0, k
            for _ in range(500):
                w = where[side][at]
                slots[side][w], at = at, slots[side][w]
                if at < 0:
                    break
                side ^= 1
            else:
                raise RuntimeError("pair table too full")
        self.keys, self.rank, self.ids = [], [], []
        for s in slots:
            s = np.array(s)
            full = s >= 0
            for out, src, none in ((self.keys, pairs, -1), (self.rank, ranks, NO_RANK), (self.ids, ids, 0)):
                col = np.full(len(s), none, src.dtype)
                col[full] = src[s[full]]
                out.append(col)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = key.astype(np.uint64)
        a = ((u * self.mult[0]) >> self.shift).astype(np.int64)
        b = ((u * self.mult[1]) >> self.shift).astype(np.int64)
        hit_a, hit_b = self.keys[0][a] == key, self.keys[1][b] == key
        rank = np.where(hit_a, self.rank[0][a], np.where(hit_b, self.rank[1][b], NO_RANK))
        return rank, np.where(hit_a, self.ids[0][a], self.ids[1][b])


NO_RANK = np.int32(2**31 - 1)
WIDE = 1 << 17


SPACE, LETTER, NUMBER, OTHER = range(4)
KIND = np.array([SPACE if chr(b) in " \t\n\x0b\f\r" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(b))[0], OTHER) for b in range(256)], np.uint8)
LOWER = np.array([ord(chr(b).lower()) for b in range(256)], np.uint8)
SHORT = 16  # bytes of a word in two keys
_FIRST, _SECOND = (np.array([(1 << 8 * min(max(n - d, 0), 8)) - 1 for n in range(SHORT + 1)], np.uint64) for d in (0, 8))


class WordTable:
    """Numbers of words, each told by two 64-bit keys that hold all of it: open addressing, many words a step."""

    def __init__(self, bits: int = 18) -> None:
        self.n = 0
        self.empty(bits)

    def empty(self, bits: int) -> None:
        self.bits = bits
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words that are not there."""
        slot, last = self.slot(first, second), (1 << self.bits) - 1
        out = self.number[slot]
        left = np.nonzero((out >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))[0]
        slot = slot[left]
        while len(left):
            slot = slot + 1 & last
            out[left] = n = self.number[slot]
            on = (n >= 0) & ((self.first[slot] != first[left]) | (self.second[slot] != second[left]))
            left, slot = left[on], slot[on]
        return out

    def add(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, repeats included, and the places of those that are new, by their numbers."""
        if 2 * (self.n + len(first)) > 1 << self.bits:
            self.grow((2 * (self.n + len(first))).bit_length())
        out, fresh = np.empty(len(first), np.int32), []
        left, slot, last = np.arange(len(first), dtype=np.int32), self.slot(first, second), (1 << self.bits) - 1
        while len(left):
            free = self.number[slot] < 0
            want, at = left[free], slot[free]
            self.number[at] = want  # of those that want one slot, one gets it
            got = self.number[at] == want
            want, at = want[got], at[got]
            self.first[at], self.second[at] = first[want], second[want]
            self.number[at] = np.arange(self.n, self.n + len(want))
            self.n += len(want)
            fresh.append(want)
            same = (self.first[slot] == first[left]) & (self.second[slot] == second[left])
            out[left[same]] = self.number[slot[same]]
            left, slot = left[~same], slot[~same] + 1 & last
        return out, np.concatenate(fresh) if fresh else left

    def grow(self, bits: int) -> None:
        used, n = self.number >= 0, self.n
        first, second, number = self.first[used], self.second[used], self.number[used]
        self.empty(bits)
        self.n = 0
        anew = self.add(first, second)[0]
        old = np.empty(len(anew), np.int32)
        old[anew] = number
        used = self.number >= 0
        self.number[used] = old[self.number[used]]
        self.n = n


def utf8(raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of words of Latin-1 bytes, one after another, and how many bytes each has."""
    wide = raw > 127
    if not wide.any():
        return raw, lens
    at = np.arange(len(raw)) + np.cumsum(wide) - wide
    out = np.empty(len(raw) + int(wide.sum()), np.uint8)
    out[at] = np.where(wide, 0xC0 | raw >> 6, raw)
    out[at[wide] + 1] = 0x80 | raw[wide] & 0x3F
    return out, lens + np.add.reduceat(wide.astype(np.int64), np.cumsum(lens) - lens)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + len], one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


class WordTokens:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        added = whole.get("added_tokens") or ()
        self.literal = [t["content"] for t in added if not t.get("normalized")]
        folded = [re.escape(t["content"]) for t in added if t.get("normalized")]
        self.folded = re.compile("|".join(folded), re.IGNORECASE).search if folded else None
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = _byte_letters()
        self.plain = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int64)
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        ids = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.pairs = PairTable(a * WIDE + b, np.arange(len(merges), dtype=np.int32), ids)
        import regex

        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.clear()
        self.clear_words()

    def may_hold_added(self, text: str) -> bool:
        return any(x in text for x in self.literal) or (self.folded is not None and self.folded(text) is not None)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def clear_words(self) -> None:
        self.table, self.long = WordTable(), {}
        self.words = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)  # ids, start and length by number

    def merge(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after another, and how many each has: each round merges every word's pair of least rank."""
        if not len(lens):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        word = np.repeat(np.arange(len(lens)), lens)
        sym = self.plain[raw]
        last = np.cumsum(lens) - 1
        sym[last] = self.final[raw[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank, new = self.pairs(sym[:-1] * WIDE + sym[1:])
            rank[word[:-1] != word[1:]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            first = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            live = least < NO_RANK
            if not live.all():
                done.append((word[~live], sym[~live]))
            hit = np.nonzero((rank == least) & live)[0]
            if not len(hit):
                break
            # in a run of overlapping pairs every other one merges, from the left
            start = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run = np.nonzero(start)[0]
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[within % 2 == 0]
            sym[hit] = new[hit]
            live[hit + 1] = False
            word, sym = word[live], sym[live]
        words, syms = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return syms[order].astype(np.uint32), np.bincount(words, minlength=len(lens))

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks into the cache."""
        known: dict[str, int] = {}
        number = known.setdefault
        flat: list[int] = []  # pre-token numbers of all chunks; odd chunks have negative ones
        counts: list[int] = []
        odd: list[str] = []
        for c in chunks:
            if c.isascii():
                low = c.lower()
            elif max(c) < "\u0250":
                low = unicodedata.normalize("NFC", c).lower()
            else:
                odd.append(c)
                flat.append(-len(odd))
                counts.append(1)
                continue
            if low.isalpha():
                flat.append(number(low, len(known)))
                counts.append(1)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                flat.append(number(low[:-1], len(known)))
                flat.append(number(low[-1], len(known)))
                counts.append(2)
            else:
                parts = self.split(low)
                flat += [number(p, len(known)) for p in parts]
                counts.append(len(parts))
        tokens = [p.encode() for p in known]
        ids, lens = self.merge(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        other = [e.ids for e in self.lib.encode_batch(odd, add_special_tokens=False)] if odd else []
        ids = np.concatenate((ids, np.array([x for o in other for x in o], np.uint32)))
        lens = np.concatenate((lens, np.fromiter(map(len, other), np.int64, len(other))))
        starts = np.cumsum(lens) - lens
        part = np.array(flat, np.int64)
        part = np.where(part < 0, len(known) - 1 - part, part)
        ids, part_lens = gather(ids, starts[part], lens[part]), lens[part]
        sums = np.concatenate(([0], np.cumsum(part_lens)))
        ends = np.cumsum(np.array(counts, np.int64))
        own = sums[ends] - sums[ends - counts]
        base = len(self.at)
        self.at.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(own) - own))
        self.flat = np.concatenate((self.flat, ids))
        self.lens = np.concatenate((self.lens, own))

    def learn_words(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        """Ids of words that got the next numbers."""
        ids, own = self.merge(*utf8(gather(low, starts, lens), lens))
        flat, at, n = self.words
        self.words = np.concatenate((flat, ids)), np.concatenate((at, len(flat) + np.cumsum(own) - own)), np.concatenate((n, own))

    def by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text of Latin-1 bytes."""
        buf = np.frombuffer(b" ".join([*texts, b" " * 2 * SHORT]), np.uint8)
        low, kind = LOWER[buf], KIND[buf]
        new = kind == NUMBER
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        quote = np.nonzero((buf == ord("'")) & new)[0]  # 's|'t|'re|'ve|'m|'ll|'d
        a, b = low[quote + 1], low[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        new[quote[one | two] + 1] = False
        new[quote[one] + 2] = True
        new[quote[two] + 3] = True
        at = np.nonzero(new)[0]
        word = kind[at] != SPACE
        starts, lens = at[word], np.diff(at, append=len(buf))[word]
        if self.table.n > WORDS:
            self.clear_words()
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from each place on
        short = np.minimum(lens, SHORT)
        first, second = eight[starts] & _FIRST[short], eight[starts + 8] & _SECOND[short]
        number = self.table.find(first, second)
        large = np.nonzero(lens > SHORT)[0]
        number[large] = 0
        miss = np.nonzero(number < 0)[0]
        fresh = []
        for k in range(0, len(miss), STEP):
            part = miss[k : k + STEP]
            number[part], places = self.table.add(first[part], second[part])
            fresh.append(part[places])
        for k, s, n in zip(large.tolist(), starts[large].tolist(), lens[large].tolist(), strict=True):
            w = low[s : s + n].tobytes()
            if w not in self.long:
                self.long[w] = self.table.n
                self.table.n += 1
                fresh.append([k])
            number[k] = self.long[w]
        if fresh:
            fresh = np.concatenate(fresh)
            self.learn_words(low, starts[fresh], lens[fresh])
        flat, at, n = self.words
        own = n[number]
        sums = np.concatenate(([0], np.cumsum(own)))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return np.split(gather(flat, at[number], own), sums[np.searchsorted(starts, ends)][:-1])

    def by_chunks(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text without odd white space or added tokens."""
        split = [t.split() for t in texts]
        if len(self.at) > CACHE:
            self.clear()
        new = set().union(*split).difference(self.at)
        if new:
            self.learn(list(new))
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        lens = self.lens[idx]
        ids = gather(self.flat, self.starts[idx], lens)
        cuts = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(n)]
        return np.split(ids, cuts[:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        out: dict[int, np.ndarray] = {}
        latin: dict[int, bytes] = {}
        rest: dict[int, str] = {}
        for k, t in enumerate(texts):
            if not t.isascii() and _ODD_SPACE.search(t) or _CONTROL.search(t) or self.may_hold_added(t):
                out[k] = np.array(self.exact.encode(t, add_special_tokens=False).ids, np.uint32)
            elif "\0" in t:  # keys end in zeros
                rest[k] = t
            else:
                try:
                    latin[k] = t.encode("latin-1")
                except UnicodeEncodeError:
                    rest[k] = t
        for part, ids in ((latin, self.by_words), (rest, self.by_chunks)):
            if part:
                out |= zip(part, ids(list(part.values())), strict=True)
        return [out[k] for k in range(len(texts))]


_CONTROL = re.compile("[\x1c-\x1f]")
_LOADED: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
