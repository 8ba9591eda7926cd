"""Prediction by partial matching over bytes: a context trie of bounded order, held as sorted packed nodes.

A text is coded as its UTF-8 bytes and one end byte 0xFF, after ORDER start bytes 0xFF (no UTF-8 text holds that byte).
Node counts come from the training texts. A byte s after context c (longest first) costs

* in c with count n(s), total T and q distinct bytes, after leaving out the bytes seen in the longer context (symbol
  exclusion): (n(s) - 1/2) / T', T' without the excluded bytes;
* an escape q' / (2 T') where c does not have s, and the search goes on with the next shorter context;
* below order zero every byte not yet excluded is equally likely.

The bytes seen after a context were all seen after each shorter one, so T' and q' depend on the two contexts only and are
stored with the longer one: coding takes one table look-up per order tried, on whole arrays.

``adapted`` then lets the document itself speak: contexts of OWN_ORDER bytes that it has shown before give a byte seen n
of T times, with q distinct bytes, (n - 1/2 + (q/2 + 1) p) / (T + 1), where p is the trie's probability, which takes
what the document's own counts leave to other bytes. Both are probabilities over all bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

ORDER = 5
OWN_ORDER = 6
END = 0xFF


def spread(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed (context, byte) keys of order + 1 bytes of every coded byte of all texts, the text number of each, and lengths."""
    head, tail = b"\xff" * order, b"\xff"
    raw = np.frombuffer(b"".join([x for t in texts for x in (head, t, tail)]), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    key = np.zeros(max(0, len(raw) - order), np.int64)
    for k in range(order + 1):
        key <<= 8
        key |= raw[k : k + len(key)]
    coded = np.ones(len(key), bool)
    ends = np.cumsum(lens + order)
    for k in range(1, order + 1):  # keys that end in a start byte of the next text
        at = ends[:-1] - order + k - 1
        coded[at] = False
    return key[coded], np.repeat(np.arange(len(texts)), lens), lens


def count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def lower_orders(keys: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Node counts of orders 0 to order from those of the highest."""
    out = [(keys, n)]
    for k in range(order - 1, -1, -1):
        got = merge([(out[0][0] & ((1 << 8 * (k + 1)) - 1), out[0][1])])
        out.insert(0, got)
    return out


class HashIndex:
    """Positions of int64 keys: open addressing with linear probes, built and read with vector operations."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.at = np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            take, where = left[free], slot[free]
            self.at[where] = take  # of several for one slot the last stays
            won = self.at[where] == take
            self.keys[where[won]] = keys[take[won]]
            rest = np.ones(len(left), bool)
            rest[np.nonzero(free)[0][won]] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        out = np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        got = self.keys[slot]
        hit = got == keys
        out[hit] = self.at[slot[hit]]
        left = np.nonzero(~hit & (got != -1))[0]
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot]
            hit = got == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (got != -1)
            left, slot = left[go], slot[go]
        return out


class Model:
    """Log10 probabilities from node counts of orders 0 to ORDER."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(levels) - 1
        self.index, self.node = [], []
        contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (keys, n) in enumerate(levels):
            # by context: keys are sorted, and the context is all but the last byte
            ctx = keys >> 8
            first = np.nonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))[0] if len(keys) else np.empty(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            q = np.diff(np.append(first, len(keys)))
            contexts.append((ctx[first], total, q, first))
            self.index.append(HashIndex(keys))
            own = np.repeat(np.log10(total), q)
            self.node.append((np.log10(n - 0.5) - own).astype(np.float32))
        #: For each context: cost of an escape from it when it is the longest, of one after the next longer context, and
        #: the denominator there.
        self.context = [HashIndex(c[0]) for c in contexts]
        self.escape = [(np.log10(c[2]) - np.log10(2.0 * c[1])).astype(np.float32) for c in contexts]
        self.counts = [n for _, n in levels]
        self.cut = []
        for k in range(self.order + 1):
            ctx, _, q, first = contexts[k]
            keys, n = levels[k]
            if k == 0:
                left = np.maximum(256 - q, 1).astype(np.float64)
                self.cut.append((left, np.zeros(len(q))))
                continue
            # counts in the shorter context of the bytes this context has seen
            low = self.index[k - 1](keys & ((1 << 8 * k) - 1))
            seen = levels[k - 1][1][low]
            excluded = np.add.reduceat(seen, first) if len(first) else seen
            lower_ctx = self.context[k - 1](ctx & ((1 << 8 * (k - 1)) - 1))
            total, types = contexts[k - 1][1][lower_ctx] - excluded, contexts[k - 1][2][lower_ctx] - q
            self.cut.append((total.astype(np.float64), types.astype(np.float64)))

    def code(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each packed (context, byte)."""
        out = np.zeros(len(keys), np.float64)
        left = np.arange(len(keys))
        above = np.full(len(keys), -1, np.int64)  # the longer context's place, -1: none known
        for k in range(self.order, -1, -1):
            own = keys[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.index[k](own)
            hit = at >= 0
            i, a = left[hit], above[hit]
            cost = self.node[k][at[hit]].astype(np.float64)
            if k < self.order:
                after = a >= 0
                cost[after] = np.log10(self.counts[k][at[hit][after]] - 0.5) - np.log10(self.cut[k + 1][0][a[after]])
            out[i] += cost
            left, above, own = left[~hit], above[~hit], own[~hit]
            if not len(left):
                return out
            ctx = self.context[k](own >> 8)
            known = ctx >= 0
            after = known & (above >= 0)
            first = known & (above < 0)
            out[left[first]] += self.escape[k][ctx[first]]
            if after.any():
                den, types = self.cut[k + 1][0][above[after]], self.cut[k + 1][1][above[after]]
                step = np.zeros(len(den))
                some = types > 0  # none: all bytes of the context are excluded, so nothing is coded in it
                step[some] = np.log10(types[some]) - np.log10(2 * den[some])
                out[left[after]] += step
            above = np.where(known, ctx, above if k == self.order else -1)
        base = np.where(above >= 0, np.log10(self.cut[0][0][np.maximum(above, 0)]) if len(self.cut[0][0]) else 0.0, np.log10(256.0))
        out[left] -= base
        return out


def ranks(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many earlier places have the same group, for places sorted by group (order)."""
    ranked = groups[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(order) else np.empty(0, bool)
    start = np.nonzero(first)[0]
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return out


def adapted(texts: list[bytes], owner: np.ndarray, log10p: np.ndarray) -> np.ndarray:
    """log10p of all coded bytes of the texts (owner: the text of each), after the document's own counts."""
    keys, _, _ = spread(texts, OWN_ORDER)
    context = ((keys >> 8) & ((1 << 8 * OWN_ORDER) - 1)) * 0x9E3779B97F4A7 ^ owner * 0x1C3DFD2A2F0F1
    code = pd.factorize(context)[0]
    at = np.nonzero(np.bincount(code)[code] > 1)[0] if len(code) else code  # contexts the text shows once say nothing
    if not len(at):
        return log10p
    code, symbol = code[at], (keys[at] & 0xFF)
    both = pd.factorize(code.astype(np.int64) << 8 | symbol)[0]
    order = np.argsort(code, kind="stable")
    seen, same = ranks(code, order), ranks(both, np.argsort(both, kind="stable"))
    new = (same == 0)[order]
    types = np.empty(len(at), np.int64)
    before = np.cumsum(new) - new  # distinct bytes so far, over all contexts; less those of contexts before
    start = np.nonzero(seen[order] == 0)[0]
    types[order] = before - np.repeat(before[start], np.diff(np.append(start, len(order))))
    heard = seen > 0
    at, seen, same, types = at[heard], seen[heard], same[heard], types[heard]
    p = 10.0 ** log10p[at]
    out = log10p.copy()
    out[at] = np.log10((np.maximum(same - 0.5, 0) + (0.5 * types + 1) * p) / (seen + 1))
    return out
