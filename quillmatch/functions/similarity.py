"""String and token-list similarities.

Levenshtein, the one-edit tests and Cosine are Column expressions. Spark has no Damerau-Levenshtein
distance, so matrices of token similarities run in Arrow batches: each batch compares its distinct
token pairs once, all of them in step, then each pair of lists picks its cells.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbouring characters turns a into b."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), True).cast("int")
    head = F.substring(a, F.lit(1), at - 1)
    tail = F.substring(a, at + 2, F.length(a))
    turned = F.concat(head, F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), tail)
    return (F.length(a) == F.length(b)) & (at > 0) & (turned == b)


def one_edit(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance 1: an insertion, deletion, substitution or swap."""
    d = F.levenshtein(a, b, 2)
    return (d == 1) | ((d == 2) & swapped(a, b))


def neighbours(token: Column) -> Column:
    """The token and all it becomes by losing one character. Two tokens that are one edit apart
    have one of these in common."""
    n = F.length(token)
    lost = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))
    return F.array_distinct(F.when(n > 0, F.array_append(lost, token)).otherwise(F.array(token)))


#: Tokens of more letters meet by segments.
SHORT = 24


def edit_keys(token: Column, probe: bool) -> Column:
    """Hashes of which a token (probe=False) and one that is one edit from it (probe=True) have one in
    common. Up to SHORT letters they are of what the token becomes by losing one letter; from SHORT on,
    of its thirds with their place: an edit touches two of them at most, if it swaps letters at their
    border, and one that it leaves alone stands where it stood, or one letter further on or back."""
    n = F.length(token)
    lost = F.transform(neighbours(token), lambda x: F.xxhash64(x))

    def third(length: Column, i: int, shift: Column) -> Column:
        start, end = F.floor(length * i / 3).cast("int"), F.floor(length * (i + 1) / 3).cast("int")
        return F.xxhash64(length, F.lit(i), F.substring(token, start + shift + 1, end - start))

    zero = F.lit(0)
    keys = [third(n, i, zero) for i in range(3)]
    if probe:  # the other token may be a letter shorter or longer
        keys += [third(n - by, i, s) for by in (-1, 1) for i in range(3) for s in (zero, F.lit(by))]
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.when(n <= SHORT, lost).otherwise(none), F.when(n >= SHORT, F.array(*keys)).otherwise(none)))


def cosine(a: Column, b: Column) -> Column:
    """Multiset overlap over the geometric mean of the sizes; 0 if either is empty."""
    shared = F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))


# --- Damerau-Levenshtein over many pairs at once ---------------------------------------------


class Words(NamedTuple):
    """Words as code points one after another, where each starts, how many it has, and which of 64
    classes of code points it has at all."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    letters: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        letters = np.zeros(len(words), dtype=np.int64)
        np.bitwise_or.at(letters, np.repeat(np.arange(len(words)), size), np.int64(1) << (flat & 63).astype(np.int64))
        return Words(flat, np.cumsum(size) - size, size, letters)

    def more(self, words: list[str]) -> Words:
        """These words and others behind them."""
        new = Words.of(words)
        new = new._replace(start=new.start + len(self.flat))
        return Words(*(np.concatenate(two) for two in zip(self, new, strict=True)))

    def codes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of these words, a row for each, and their sizes."""
        size = self.size[which]
        place = np.arange(int(size.max(initial=0)))
        inside = place < size[:, None]
        out = np.zeros(inside.shape, dtype=np.int32)
        out[inside] = self.flat[(self.start[which][:, None] + place)[inside]]
        return out, size


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return Words.of(words).codes(np.arange(len(words)))


def damerau(a: list[str], b: list[str], restricted: bool = True) -> np.ndarray:
    """Distances of a[i] and b[i]. Restricted: no part is edited twice (optimal string alignment);
    else the full distance, which may edit between swapped characters."""
    return (_restricted if restricted else _full)(*_codes(a), *_codes(b))


def _restricted(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By antidiagonals, all cells of one in step; four of them are held, by row."""
    count, rows, cols = len(x), x.shape[1], y.shape[1]
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    out = np.zeros(count, dtype=np.int32)
    held = [np.zeros((rows + 1, count), dtype=np.int32) for _ in range(5)]
    for k in range(rows + cols + 1):
        now, one, two, _, four = (held[(k - back) % 5] for back in range(5))
        low, high = max(1, k - cols), min(rows, k - 1)  # rows of the cells off both edges
        if low <= high:
            p, q = x[low - 1 : high], y[k - high - 1 : k - low][::-1]
            best = np.minimum(one[low - 1 : high], one[low : high + 1]) + 1
            best = np.minimum(best, two[low - 1 : high] + (p != q))
            # the two characters before, of both, the other way round
            i, j = max(low, 2), min(high, k - 2)
            if i <= j:
                swap = (x[i - 1 : j] == y[k - j - 2 : k - i - 1][::-1]) & (x[i - 2 : j - 1] == y[k - j - 1 : k - i][::-1])
                part = best[i - low : j - low + 1]
                np.copyto(part, np.minimum(part, four[i - 2 : j - 1] + 1), where=swap)
            now[low : high + 1] = best
        if k <= cols:
            now[0] = k
        if k <= rows:
            now[k] = k
        done = np.flatnonzero(m + n == k)
        out[done] = now[m[done], done]
    return out


def _full(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    count, rows, cols = len(x), x.shape[1], y.shape[1]
    d = np.zeros((rows + 1, cols + 1, count), dtype=np.int32)
    d[:, 0] = np.arange(rows + 1)[:, None]
    d[0] = np.arange(cols + 1)[:, None]
    every = np.arange(count)
    last = np.zeros((cols, count), dtype=np.int32)  # last row that has y's character, by column
    for i in range(1, rows + 1):
        match_col = np.zeros(count, dtype=np.int32)  # last column in this row that matched
        for j in range(1, cols + 1):
            same, best = x[:, i - 1] == y[:, j - 1], d[i, j]
            np.minimum(d[i - 1, j], d[i, j - 1], out=best)
            best += 1
            np.minimum(best, d[i - 1, j - 1] + ~same, out=best)
            both = np.flatnonzero((last[j - 1] > 0) & (match_col > 0))  # few pairs have such a swap
            if len(both):
                k, w = last[j - 1, both], match_col[both]
                best[both] = np.minimum(best[both], d[k - 1, w - 1, both] + (i - k) + (j - w) - 1)
            match_col[same] = j
        last[y.T == x[:, i - 1]] = i
    return d[m, n, every]


def similarities(a: list[str], b: list[str], restricted: bool = True, cells: int = 4_000_000) -> np.ndarray:
    """1 less the distance over the greater length; two empty tokens are alike."""
    return compared(Words.of([*a, *b]), np.arange(len(a)), np.arange(len(a), 2 * len(a)), restricted, cells)


def compared(words: Words, p: np.ndarray, q: np.ndarray, restricted: bool = True, cells: int = 4_000_000) -> np.ndarray:
    """Similarities of the words p[i] and q[i]. Words without a common letter differ in all of the
    longer one; others are compared in blocks whose matrices have so many cells together, or one pair."""
    longest = np.maximum(words.size[p], words.size[q])
    out = (longest == 0).astype(float)
    some = np.flatnonzero(words.letters[p] & words.letters[q])
    # by length, so that a block's matrices are no larger than they must be
    order = some[np.argsort(longest[some], kind="stable")]
    at = 0
    while at < len(order):
        # as many as fit if all were as long as the last of them
        area = (longest[order[at : at + cells]] + 1) ** (1 if restricted else 2)
        fit = np.flatnonzero(area * np.arange(1, len(area) + 1) <= (cells // 8 if restricted else cells))
        part = order[at : at + max(int(fit[-1]) + 1 if len(fit) else 1, 1)]
        d = (_restricted if restricted else _full)(*words.codes(p[part]), *words.codes(q[part]))
        out[part] = 1 - d / longest[part]
        at += len(part)
    return out


class Cells:
    """Similarities of all tokens of two lists. Tokens are named by numbers; distinct pairs of them
    are compared once, and a list pair's cells are picked out of what was compared. What is
    remembered is bounded: it is forgotten when it holds more than `room` pairs or tokens, or eight
    times as many letters."""

    def __init__(self, number_rule: bool = False, initial_rule: bool = False, restricted: bool = True, room: int = 1_000_000):
        self.number_rule, self.initial_rule, self.restricted, self.room = number_rule, initial_rule, restricted, room
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = {}
        self.tokens: list[str] = []
        self.words = Words.of([])
        self.keys, self.values = np.zeros(0, dtype=np.int64), np.zeros(0)

    def _exact(self, p: str, q: str) -> bool:
        if self.number_rule and p.isdigit() and q.isdigit():
            return True
        return self.initial_rule and (len(p) == 1 or len(q) == 1)

    def _named(self, tokens: list[str]) -> np.ndarray:
        names = self.names
        for t in tokens:
            if t not in names:
                names[t] = len(names)
                self.tokens.append(t)
        return np.fromiter((names[t] for t in tokens), dtype=np.int64, count=len(tokens))

    def _pairs(self, a: list[str], b: list[str]) -> np.ndarray:
        p, q = self._named(a)[:, None], self._named(b)[None, :]
        return (np.minimum(p, q) << 32) | np.maximum(p, q)

    def prepare(self, pairs: list[tuple[list[str], list[str]]]) -> None:
        """Compare what these list pairs need. Their cells together bound the memory."""
        if len(self.keys) > self.room or len(self.tokens) > self.room or len(self.words.flat) > 8 * self.room:
            self._forget()
        parts = [np.unique(self._pairs(a, b)) for a, b in pairs if a and b]
        if not parts:
            return
        wanted = np.setdiff1d(np.concatenate(parts), self.keys)
        p, q = wanted >> 32, wanted & 0xFFFFFFFF
        value = (p == q).astype(float)
        other = np.flatnonzero(p != q)
        if self.number_rule or self.initial_rule:
            other = np.array([i for i in other.tolist() if not self._exact(self.tokens[p[i]], self.tokens[q[i]])], dtype=np.int64)
        self.words = self.words.more(self.tokens[len(self.words.size) :])
        value[other] = compared(self.words, p[other], q[other], self.restricted)
        keys, values = np.concatenate([self.keys, wanted]), np.concatenate([self.values, value])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def of(self, pairs: list[tuple[list[str], list[str]]]) -> Matrices:
        """The matrices of list pairs that prepare() got."""
        rows, cols = (np.array([len(x[k]) for x in pairs], dtype=np.int64) for k in (0, 1))
        keys = [self._pairs(a, b).ravel() for a, b in pairs]
        return Matrices(rows, cols, self.values[np.searchsorted(self.keys, np.concatenate([np.zeros(0, dtype=np.int64), *keys]))])


class Matrices:
    """Cells of many matrices, row by row and one matrix after another, none of them empty, and what
    greedy matching picks of all of them at once: the largest cell of a matrix again and again, each
    row and column once; of equal cells the first by row, then column. A cell is picked when it
    comes first, in that order, in its row and in its column; those rows and columns go, and so on:
    that needs far fewer rounds than there are picks."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.rows, self.cols, self.values = rows, cols, values
        size = rows * cols
        self.of = np.repeat(np.arange(len(rows)), size)
        local = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
        self.row, self.col = np.divmod(local, np.repeat(cols, size)) if len(values) else (local, local)

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells that are picked, by matrix and then in the order of picking, and each one's step."""
        order = np.lexsort((self.col, self.row, -self.values, self.of))
        row = (np.cumsum(self.rows) - self.rows)[self.of[order]] + self.row[order]
        col = (np.cumsum(self.cols) - self.cols)[self.of[order]] + self.col[order]
        first_row, first_col = np.empty(int(self.rows.sum()), dtype=np.int64), np.empty(int(self.cols.sum()), dtype=np.int64)
        left, found = np.arange(len(order)), []
        while len(left):
            r, c, back = row[left], col[left], left[::-1]
            first_row[row[back]] = back  # the last that is written is the first in order
            first_col[col[back]] = back
            chosen = left[(first_row[r] == left) & (first_col[c] == left)]
            found.append(chosen)
            gone_row, gone_col = np.zeros(len(first_row), dtype=bool), np.zeros(len(first_col), dtype=bool)
            gone_row[row[chosen]] = gone_col[col[chosen]] = True
            left = left[~(gone_row[r] | gone_col[c])]
        cells = order[np.sort(np.concatenate(found))] if found else order
        steps = np.minimum(self.rows, self.cols)
        return cells, np.arange(len(cells)) - np.repeat(np.cumsum(steps) - steps, steps)

    def means(self, mu: float) -> np.ndarray:
        """Of each matrix the mean of the greedy cells, or of the first of them whose mean is below mu."""
        cells, step = self.picks()
        many = np.minimum(self.rows, self.cols)
        value, first = self.values[cells], np.cumsum(many) - many
        total, mean, going = np.zeros(len(many)), np.zeros(len(many)), np.arange(len(many))
        for n in range(int(many.max(initial=0))):
            going = going[many[going] > n]
            total[going] += value[first[going] + n]
            mean[going] = total[going] / (n + 1)
            going = going[mean[going] >= mu]
        return mean

    def weights(self, cells: np.ndarray) -> np.ndarray:
        """The weights of cells by row: the first row's is the greatest."""
        m = self.rows[self.of[cells]]
        return (m - self.row[cells]) / (m * (m + 1) / 2)

    def weighted(self) -> np.ndarray:
        """Of each matrix the sum of the greedy cells with their weights."""
        cells, _ = self.picks()
        return np.bincount(self.of[cells], weights=self.values[cells] * self.weights(cells), minlength=len(self.rows))

    def best_of_rows(self) -> np.ndarray:
        """Of each matrix the mean over its rows of their largest cells."""
        starts = np.cumsum(np.repeat(self.cols, self.rows)) - np.repeat(self.cols, self.rows)
        best = np.maximum.reduceat(self.values, starts) if len(starts) else self.values
        return np.bincount(np.repeat(np.arange(len(self.rows)), self.rows), weights=best, minlength=len(self.rows)) / np.maximum(self.rows, 1)


#: Comparators over matrices: of those of a batch and mu, the scores. Whether the shorter list makes the rows.
MATRIX_COMPARATORS: dict[str, tuple[Callable[[Matrices, float], np.ndarray], bool]] = {
    "ScoringMatrixStd": (lambda m, mu: m.means(mu), False),
    "ScoringMatrixKris": (lambda m, mu: m.weighted(), True),
    "MongeElkan": (lambda m, mu: m.best_of_rows(), False),
}
COMPARATORS = (*MATRIX_COMPARATORS, "Cosine")
