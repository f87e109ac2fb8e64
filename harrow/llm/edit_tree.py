"""BK-trees under the unrestricted Damerau-Levenshtein distance, searched in batches.

The unrestricted distance (insertion, deletion, substitution and transposition, also
with edits in between) is a true metric, so the triangle inequality prunes without
losing a match; the restricted variant is none. The reference strings are sharded by
length, one tree for each, because strings within t edits differ by at most t in
length. A batch of queries walks a tree together: at each node one vectorised dynamic
programme gives the distances of all queries still alive, and a child at edge d stays
alive for the queries whose distance lies within d +/- their threshold. The winners
of the shards are merged.
"""

from __future__ import annotations

import numpy as np


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance of two strings."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    last_row: dict[str, int] = {}
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        x, match = a[i - 1], 0
        above, row = rows[i], [far, i]
        for j in range(1, m + 1):
            y = b[j - 1]
            k, l = last_row.get(y, 0), match
            if x == y:
                best, match = above[j], j
            else:
                best = min(above[j], above[j + 1], row[j]) + 1
            swapped = rows[k][l] + (i - k - 1) + 1 + (j - l - 1)
            row.append(swapped if swapped < best else best)
        last_row[x] = i
        rows.append(row)
    return rows[n + 1][m + 1]


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a padded matrix of code points (pad -1) and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    matrix = np.full((len(texts), max(1, int(lengths.max(initial=0)))), -1, dtype=np.int32)
    for i, t in enumerate(texts):
        if t:
            matrix[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return matrix, lengths


def distances(queries: np.ndarray, lengths: np.ndarray, word: str) -> np.ndarray:
    """Distances of every query (a row of ``queries``) to one word, by anti-diagonals."""
    n, width = queries.shape
    p = len(word)
    codes = np.array([ord(c) for c in word], dtype=np.int32)
    same = queries.T[:, None, :] == codes[None, :, None]  # query place, word place, query
    places = np.arange(1, width + 1, dtype=np.int16)[:, None, None]
    upto = np.maximum.accumulate(np.where(same, places, np.int16(0)), axis=0)
    earlier = np.zeros_like(upto)  # last query place before this one with the word's character
    earlier[1:] = upto[:-1]
    columns = np.arange(1, p + 1, dtype=np.int16)[None, :, None]
    over = np.maximum.accumulate(np.where(same, columns, np.int16(0)), axis=1)
    before = np.zeros_like(over)  # last word place before this one with the query's character
    before[:, 1:] = over[:, :-1]
    swap = (earlier > 0) & (before > 0)
    cost = (~same).astype(np.int16)
    table = np.empty((width + 1, p + 1, n), dtype=np.int16)
    table[0] = np.arange(p + 1, dtype=np.int16)[:, None]
    table[:, 0] = np.arange(width + 1, dtype=np.int16)[:, None]
    for s in range(2, width + p + 1):
        i = np.arange(max(1, s - p), min(width, s - 1) + 1)
        j = s - i
        best = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + cost[i - 1, j - 1])
        d, q = np.nonzero(swap[i - 1, j - 1])
        if len(d):
            a, b = i[d], j[d]
            k, m = earlier[a - 1, b - 1, q].astype(np.int64), before[a - 1, b - 1, q].astype(np.int64)
            moved = table[k - 1, m - 1, q] + (a - k - 1) + 1 + (b - m - 1)
            best[d, q] = np.minimum(best[d, q], moved)
        table[i, j] = best
    return table[lengths, p, np.arange(n)].astype(np.int64)


class EditTree:
    """BK-trees over reference strings, one for each length; equal strings share a node."""

    def __init__(self, words: list[str]) -> None:
        self.words: list[str] = []
        self.children: list[dict[int, int]] = []
        self.roots: dict[int, int] = {}
        for w in dict.fromkeys(words):
            self._add(w)

    def _add(self, word: str) -> None:
        new = len(self.words)
        self.words.append(word)
        self.children.append({})
        at = self.roots.setdefault(len(word), new)
        while at != new:
            at = self.children[at].setdefault(distance(word, self.words[at]), new)

    def within(self, queries: list[str], thresholds: list[int]) -> list[list[tuple[int, int]]]:
        """For each query all (distance, node) within its threshold; no entry is missed."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.words or not queries:
            return found
        matrix, lengths = encoded(queries)
        limits = np.array(thresholds, dtype=np.int64)
        stack = []
        for length, root in self.roots.items():
            near = np.flatnonzero(np.abs(lengths - length) <= limits)
            if len(near):
                stack.append((root, near))
        while stack:
            node, alive = stack.pop()
            for lo in range(0, len(alive), 1024):
                part = alive[lo : lo + 1024]
                width = max(1, int(lengths[part].max()))
                d = distances(matrix[part, :width], lengths[part], self.words[node])
                for i in np.flatnonzero(d <= limits[part]):
                    found[part[i]].append((int(d[i]), node))
                for edge, child in self.children[node].items():
                    go = np.abs(d - edge) <= limits[part]
                    if go.any():
                        stack.append((child, part[go]))
        return found
