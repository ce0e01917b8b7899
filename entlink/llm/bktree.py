"""BK-trees under the Levenshtein distance, searched for many strings at once.

Entries are sharded by length, one tree a shard; a search with threshold t looks into the shards
whose length differs by at most t. Distances of many (query, entry) pairs are computed together:
the bit vectors of one column of each distance matrix are one 64-bit word, and array operations
advance all matrices by a column. The triangle inequality leaves out every child whose edge lies
outside [d - t, d + t], so all entries within the threshold are found. A node without children is
not measured at all if the sets of its signs and the query's differ too much.

Signs beyond the ``SIGNS`` most frequent ones share a code, so the bit vectors of an entry have a fixed size for any script.
The trees then measure the strings of codes: that is a metric too, and never more than the distance of the strings
themselves, so no entry is lost; what is found is measured again.

A search for edits in which a swap of two neighbours is one edit goes through the same trees: k such
edits between strings whose lengths differ by l are at most 2 k - l edits of the Levenshtein distance, as
l of them are no swaps, and change at most k signs of either set.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Longest string that the bit vectors hold; longer entries are kept aside and compared one by one.
WIDEST = 64
#: Signs with a code of their own.
SIGNS = 62
#: Pairs that are measured at once.
BLOCK = 16_384


def plain_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of two strings, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        low = i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            low = min(low, row[j])
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


class BKForest:
    """All entries of a reference list, ready for searches."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        used = Counter(c for e in entries for c in e)
        signs = sorted(used, key=lambda c: (-used[c], c))
        self.sign = {c: min(k, SIGNS) + 1 for k, c in enumerate(signs)}
        self.alphabet = min(len(signs), SIGNS + 1) + 1
        self.shared = len(signs) > SIGNS + 1
        self.length = np.array([len(e) for e in entries], np.int64)
        self.long = [k for k, e in enumerate(entries) if len(e) > WIDEST]
        short = np.flatnonzero((self.length <= WIDEST) & (self.length > 0))
        self.peq = np.zeros((len(entries), self.alphabet), np.uint64)
        self.mask = np.zeros(len(entries), np.uint64)
        self.root: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(self.length[short]).tolist():
            rows = short[self.length[short] == size]
            codes = np.array([self._code(entries[k]) for k in rows]).reshape(len(rows), size)
            for place in range(size):
                self.peq[rows, codes[:, place]] |= np.uint64(1 << place)
            self.mask[rows] = np.bitwise_or.reduce(np.uint64(1) << (codes % 64).astype(np.uint64), axis=1)
            self.root[size] = int(rows[0])
            # all nodes of a depth at once: the first entry at a distance from its node is the child, the others go on below it
            at, node = np.arange(1, len(rows)), np.zeros(len(rows) - 1, np.int64)
            while len(at):
                d = np.concatenate([self._distance(codes[node[k : k + BLOCK]], rows[at[k : k + BLOCK]]) for k in range(0, len(at), BLOCK)])
                order = np.lexsort((at, d, node))
                at, node, d = at[order], node[order], d[order]
                new = np.concatenate(([True], (node[1:] != node[:-1]) | (d[1:] != d[:-1])))
                edges.append((rows[node[new]], d[new], rows[at[new]]))
                child = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
                at, node = at[~new], child[~new]
        parent, edge, child = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in range(3))
        key = parent * 256 + edge
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]
        self.leaf = np.ones(len(entries), bool)
        self.leaf[parent] = False

    def _code(self, s: str) -> np.ndarray:
        return np.array([self.sign.get(c, 0) for c in s], np.int64)

    def _distance(self, codes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Distance of each row of signs to its entry."""
        one = np.uint64(1)
        m = self.length[entries].astype(np.uint64)
        top = one << (m - one)
        pv, mv = np.full(len(entries), ~np.uint64(0)), np.zeros(len(entries), np.uint64)
        score = self.length[entries].copy()
        flat, base = self.peq.ravel(), entries * self.alphabet
        for j in range(codes.shape[1]):
            eq = flat[base + codes[:, j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += (ph & top) != 0
            score -= (mh & top) != 0
            ph = (ph << one) | one
            mh = mh << one
            pv = mh | ~(xv | ph)
            mv = ph & xv
        return score

    def search(self, queries: list[str], thresholds: np.ndarray, swaps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of every entry within each query's threshold.

        With ``swaps`` the thresholds count a swap of neighbours as one edit; every entry within them is among the
        results, beside others, and the distance is still Levenshtein's.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(q) for q in queries], np.int64)
        for k in self.long:
            for q in np.flatnonzero(np.abs(sizes - self.length[k]) <= thresholds):
                most = int(2 * thresholds[q] - abs(sizes[q] - self.length[k]) if swaps else thresholds[q])
                d = plain_distance(queries[q], self.entries[k], most)
                if d <= most:
                    found.append((np.array([q]), np.array([k]), np.array([d])))
        for size in np.unique(sizes):
            size = int(size)
            rows = np.flatnonzero(sizes == size)
            if size == 0 or size > WIDEST + int(thresholds[rows].max()):
                continue
            codes = np.array([self._code(queries[q]) for q in rows]).reshape(len(rows), size)
            masks = np.bitwise_or.reduce(np.uint64(1) << (codes % 64).astype(np.uint64), axis=1)
            limit = thresholds[rows]
            reach = int(limit.max())
            for other in range(max(1, size - reach), size + reach + 1):
                if other not in self.root:
                    continue
                near = np.flatnonzero(limit >= abs(other - size))
                far = 2 * limit - abs(other - size) if swaps else limit
                query, node = near, np.full(len(near), self.root[other])
                while len(query):
                    more_q, more_n = [], []
                    for b in range(0, len(query), BLOCK):
                        q, n = query[b : b + BLOCK], node[b : b + BLOCK]
                        d = self._distance(codes[q], n)
                        hit = d <= far[q]
                        if hit.any():
                            found.append((rows[q[hit]], n[hit], d[hit]))
                        first = np.searchsorted(self.key, n * 256 + np.maximum(d - far[q], 0))
                        count = np.searchsorted(self.key, n * 256 + d + far[q] + 1) - first
                        owner = np.repeat(np.arange(len(q)), count)
                        at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(count) - count), count)
                        cq, cn = q[owner], self.child[at]
                        mq, me = masks[cq], self.mask[cn]
                        apart = np.maximum(np.bitwise_count(mq & ~me), np.bitwise_count(me & ~mq))
                        keep = ~self.leaf[cn] | (apart <= limit[cq])
                        more_q.append(cq[keep])
                        more_n.append(cn[keep])
                    query, node = np.concatenate(more_q), np.concatenate(more_n)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, entry, distance = (np.concatenate([f[k] for f in found]) for k in range(3))
        if self.shared:
            far = 2 * thresholds[query] - np.abs(sizes[query] - self.length[entry]) if swaps else thresholds[query]
            distance = np.array([plain_distance(queries[q], self.entries[e], int(most)) for q, e, most in zip(query, entry, far)], np.int64)
            near = distance <= far
            query, entry, distance = query[near], entry[near], distance[near]
        return query, entry, distance
