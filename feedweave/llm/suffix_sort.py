"""Linear suffix sorting by grouping.

Phase 1 gathers suffixes of equal Lyndon prefix into groups, in the order of those prefixes. It starts with groups of equal
first symbols and takes them in descending order; every suffix of the group at hand finds its previous smaller suffix
(pointers of higher groups lead over what is larger), and that suffix's prefix grows by the group's prefix, as many times
as copies of it follow: suffixes with more copies become higher subgroups of their group.

Phase 2 fills the groups in ascending order. A sorted suffix k makes k - 1, its previous smaller suffix, that one's and so
on the next free members of their groups, until one is already placed. No symbol is ever renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers; the end of the text sorts before every symbol."""
    n = len(symbols) + 1
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    count = np.zeros(n, np.int64)
    count[starts] = sizes
    sa, group, at, size = order.tolist(), rank.tolist(), place.tolist(), count.tolist()  # size by the group's start
    smaller, copies = [-1] * n, [1] * n
    end = n
    while end > 1:
        s = sa[end - 1]
        low = group[s]
        if end - low == 1:  # one suffix: at most one prefix grows
            p = s - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    last = g + k - 1
                    i, other = at[p], sa[last]
                    sa[i], sa[last] = other, p
                    at[other], at[p] = i, last
                    size[g], size[last], group[p] = k - 1, 1, last
            end = low
            continue
        most: dict[int, int] = {}
        for s in sorted(sa[low:end]):
            p = s - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            if p >= 0 and group[p] == low:  # the group's prefix again: one more copy
                copies[s] = copies[p] + 1
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and most.get(p, 0) < copies[s]:
                most[p] = copies[s]
        by: dict[int, list[int]] = {}
        for p, k in most.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            touched: dict[int, list[int]] = {}
            for p in by[k]:
                g = group[p]
                last = g + size[g] - 1
                i, other = at[p], sa[last]
                sa[i], sa[last] = other, p
                at[other], at[p] = i, last
                size[g] -= 1
                touched.setdefault(g, []).append(p)
            for g, moved in touched.items():
                new = g + size[g]  # what left a group together is a group; where all of it left, the group stays what it was
                size[new] = len(moved)
                if new != g:
                    for p in moved:
                        group[p] = new
        end = low
    free = list(range(n))
    out = [0] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return np.array(out[1:], np.int64)
