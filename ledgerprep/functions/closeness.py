"""Names of a bounded set compared with each other, inside a task.

A pair is looked at twice. First the letters of both are compared as bags, for all pairs of two lists in
one matrix product: a bag is written as the bits "at least k of this letter", so the product counts
the letters two names have in common, and what no common letters can bring to the threshold is done with.
Then, for the pairs left, the longest common subsequence or the edit distance is found once, by bit vectors
over all pairs of a batch; it decides, and it is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ledgerprep.functions.similarity import _lcs_long

_WORD = 64
_BINS, _LEVELS = 32, 4
_SLACK = 0.01
#: Rows compared with all others at a time, pairs scored at a time, and letters told apart by tables.
ROWS, PAIRS, SYMBOLS = 512, 1 << 17, 512


def edit_distance(a: str, b: str) -> int:
    row = np.arange(len(b) + 1)
    letters = np.array(list(b))
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (letters != x))
        row = np.minimum.accumulate(new - steps) + steps  # letters left out of b
    return int(row[-1])


class Names:
    """A list of names, none of them empty, and the threshold they are compared at."""

    def __init__(self, texts: list[str], threshold: float, scorer: str):
        self.texts, self.threshold, self.edits = texts, float(threshold), scorer == "levenshtein"
        n = len(texts)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(n), self.sizes)
        bags = np.bincount(row * _BINS + flat % _BINS, minlength=n * _BINS).reshape(n, _BINS)
        bits = np.hstack([bags >= k for k in range(1, _LEVELS + 1)]).astype(np.float32)
        # Common letters needed: a share of both lengths. Beyond the last bit a pair gets the benefit of the doubt.
        share = self.threshold / 100 - 0.5 if self.edits else self.threshold / 200
        doubt = np.maximum(bags - _LEVELS, 0).sum(axis=1) / 2 - share * self.sizes
        one = np.ones((n, 1), dtype=np.float32)
        own = doubt.astype(np.float32)[:, None]
        self._left, self._right = np.hstack([bits, own, one]), np.hstack([bits, one, own])
        self._short = self.sizes <= _WORD
        kept = self._short[row]
        symbols, code = np.unique(flat[kept], return_inverse=True)
        self._tables = len(symbols) <= SYMBOLS
        if self._tables:
            row, place = row[kept], (np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes))[kept]
            self._codes = np.full((n, _WORD), len(symbols), dtype=np.int64)
            self._codes[row, place] = code
            self._masks = np.zeros((n, len(symbols) + 1), dtype=np.uint64)
            np.bitwise_or.at(self._masks, (row, code), np.left_shift(np.uint64(1), place.astype(np.uint64)))

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of ``a`` and ``b`` whose letters can bring them to the threshold."""
        i, j = np.nonzero(self._left[a] @ self._right[b].T >= -_SLACK)
        return a[i], b[j]

    def _matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of all letters of both names, those not inserted, left out or (for edits) replaced."""
        total = self.sizes[i] + self.sizes[j]
        out = np.empty(len(i), dtype=np.int64)
        quick = self._short[i] & self._short[j] & self._tables
        for k in np.flatnonzero(~quick).tolist():
            a, b = self.texts[i[k]], self.texts[j[k]]
            out[k] = total[k] - edit_distance(a, b) if self.edits else 2 * _lcs_long(a, b)
        some = np.flatnonzero(quick)
        a, b = i[some], j[some]
        if len(some):
            out[some] = total[some] - self._edits(a, b) if self.edits else 2 * self._common(a, b)
        return out

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common subsequences (Hyyrö 2004): a zero bit marks where one grows."""
        full = np.full(len(i), ~np.uint64(0))
        vector = full.copy()
        with np.errstate(over="ignore"):
            for at in range(int(self.sizes[j].max())):
                hit = vector & self._masks[i, self._codes[j, at]]
                vector = (vector + hit) | (vector - hit)
        size = self.sizes[i].astype(np.uint64)
        full = np.where(size == _WORD, full, np.left_shift(np.uint64(1), size % np.uint64(_WORD)) - np.uint64(1))
        return np.bitwise_count(~vector & full).astype(np.int64)

    def _edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distances (Myers 1999): bits tell where a column of the table rises or falls."""
        one = np.uint64(1)
        distance, size = self.sizes[i].copy(), self.sizes[j]
        last = np.left_shift(one, (distance - 1).astype(np.uint64))
        up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(int(size.max())):
                same = self._masks[i, self._codes[j, at]]
                diagonal = same | down
                across = (((same & up) + up) ^ up) | same
                rise, fall = down | ~(across | up), up & across
                live = at < size
                distance += live & ((rise & last) != 0)
                distance -= live & ((fall & last) != 0)
                rise, fall = (rise << one) | one, fall << one
                up, down = fall | ~(diagonal | rise), rise & diagonal
        return distance

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs given those that reach the threshold, with their scores."""
        parts = []
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            matched, total = self._matched(a, b), self.sizes[a] + self.sizes[b]
            keep = matched * 100 >= total * self.threshold
            parts.append((a[keep], b[keep], matched[keep] / total[keep] * 100.0))
        if not parts:
            return i[:0], j[:0], np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def pairs(self, a: np.ndarray, b: np.ndarray, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All near pairs of ``a`` and ``b``, with the smaller row from ``a`` if they are one list (``ordered``)."""
        for at in range(0, len(a), ROWS):
            i, j = self.candidates(a[at : at + ROWS], b)
            if ordered:
                i, j = i[i < j], j[i < j]
            yield self.near(i, j)

    def first_near(self, leaders: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of ``rows`` near to any of the ``leaders``: the row, the first such leader, the score."""
        i, j, score = self.near(*self.candidates(leaders, rows))
        order = np.lexsort((i, j))
        first = order[np.append(True, j[order][1:] != j[order][:-1])] if len(order) else order
        return j[first], i[first], score[first]

    def led(self) -> tuple[np.ndarray, np.ndarray]:
        """Leader and score of each name by the greedy rule, the names being in their order."""
        n = len(self.texts)
        leader, score = np.arange(n), np.full(n, 100.0)
        leaders = np.zeros(0, dtype=np.int64)
        for at in range(0, n, ROWS):
            batch = np.arange(at, min(n, at + ROWS))
            if len(leaders):
                for part in range(0, len(leaders), ROWS * 8):
                    row, first, found = self.first_near(leaders[part : part + ROWS * 8], batch)
                    leader[row], score[row] = first, found
                    batch = batch[leader[batch] == batch]
            i, j, found = self.near(*self._below(batch))
            order = np.lexsort((j, i))
            for a, b, s in zip(i[order].tolist(), j[order].tolist(), found[order].tolist(), strict=True):
                # All pairs with a as the later one came before, so whether it leads is settled.
                if leader[a] == a and leader[b] == b:
                    leader[b], score[b] = a, s
            leaders = np.append(leaders, batch[leader[batch] == batch])
        return leader, score

    def _below(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.candidates(rows, rows)
        return i[i < j], j[i < j]

    def forest(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Near pairs of ``a`` and ``b`` that connect what all near pairs would.

        Rows that are connected already are not looked at. Between two connected parts one pair is scored
        first, then more at a time, so that a crowd of near copies costs little more than its links."""
        n = len(self.texts)
        root, left, right = np.arange(n), [], []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return int(x)

        for at in range(0, len(a), ROWS):
            i, j = self.candidates(a[at : at + ROWS], b)
            most = 1
            while True:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                parts = np.minimum(root[i], root[j]) * n + np.maximum(root[i], root[j])
                order = np.argsort(parts, kind="stable")
                starts = np.flatnonzero(np.append(True, parts[order][1:] != parts[order][:-1]))
                rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                now, later = order[rank < most], order[rank >= most]
                for x, y in zip(*(c.tolist() for c in self.near(i[now], j[now])[:2]), strict=True):
                    p, q = find(x), find(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(x)
                        right.append(y)
                while (root[root] != root).any():
                    root = root[root]
                i, j, most = i[later], j[later], most * 8
        return left, right
