"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. An item's
windows are its runs of `window` consecutive words; an item of fewer words, but not none, is one
window. All windows of one length are searched together: a shift table over blocks of two adjacent
words skips positions where no window can end, a bucket by the closing block selects the windows
that may end here, and a direct comparison confirms.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; windows that several items share count for each; a null item_id is named "null"; repeated
rows are judged one by one; other columns of either table are ignored, or carried on as asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, columns_of

#: Word characters stay, A-Z are lower-cased, all else parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WINDOW = 10
#: Windows searched at once; a larger benchmark is searched in blocks of so many, one after another.
BLOCK_WINDOWS = 50_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Finds all windows of one length in a list of words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, window: tuple[bytes, ...], item: str) -> int:
        """1 if the window is new."""
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = window[end - b : end]
            self.shift[key] = min(self.shift.get(key, m), m - end)
        bucket = self.buckets.setdefault(window[m - b :], {})
        new = window not in bucket
        bucket.setdefault(window, set()).add(item)
        return int(new)

    def search(self, w: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of each occurrence, by ascending start."""
        m, b, n = self.length, self.block, len(w)
        shift, far, end = self.shift.get, self.length - self.block + 1, self.length
        while end <= n:
            key = tuple(w[end - b : end])
            if step := shift(key, far):
                end += step
                continue
            found = self.buckets[key].get(tuple(w[end - m : end]))
            if found:
                yield end - m, found
            end += 1


class Index:
    """Windows of a block of items, a searcher for each length."""

    def __init__(self, window: int = WINDOW):
        self.window, self.size, self.searchers = window, 0, {}

    def add(self, item: str, w: list[bytes], start: int = 0, most: int | None = None) -> int:
        """Adds the windows of an item's words from `start` on while the index has fewer than `most`;
        returns where the next window begins."""
        length = min(self.window, len(w))
        last = len(w) - length + 1 if w else 0
        while start < last and (most is None or self.size < most):
            searcher = self.searchers.setdefault(length, WuManber(length))
            self.size += searcher.add(tuple(w[start : start + length]), item)
            start += 1
        return start if start < last else len(w)

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, searcher in self.searchers.items():
            for start, found in searcher.search(w):
                spans.append((start, start + length))
                items |= found
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Index]:
    """The items as indexes of `block_windows` windows at most; a long item's are spread over several."""
    index = Index(window)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        w = words(None if row["text"] is None else bytes(row["text"]))
        at = 0
        while (at := index.add(row["item"], w, at, block_windows)) < len(w):
            yield index
            index = Index(window)
    yield index


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: the columns `carry` and n_words, n_hit, n_items, items_sha256,
    contaminated."""
    indexes = blocks(benchmark, window, block_windows)
    first = next(indexes)
    second = next(indexes, None)
    if second is not None:
        return _in_blocks(docs, [first, second], indexes, carry)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def make():
        index = shared.value

        def judge(batch):
            out = []
            for text in batch:
                w = words(text)
                spans, items = index.hits(w)
                out.append((len(w), sum(b - a for a, b in spans), len(items), _digest(items), bool(spans)))
            return columns_of(out, 5)

        return judge

    return by_text(docs, list(carry), _RESULT, make)


def _in_blocks(docs: DataFrame, begun: list[Index], rest: Iterator[Index], carry: tuple[str, ...]) -> DataFrame:
    """Each block is searched in a pass of its own that returns only documents with hits; their
    spans and items are then united by document and text. No task holds more than one block."""
    text_hash = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", text_hash.alias("_h"))

    def searcher(shared):
        def make():
            def search(batch):
                found = [shared.value.hits(words(t)) for t in batch]
                return columns_of([([a for a, _ in x], [b for _, b in x], sorted(i)) for x, i in found], 3)

            return search

        return make

    hits = None
    while begun:
        shared = docs.sparkSession.sparkContext.broadcast(begun.pop(0))
        part = by_text(keyed, ["doc_id", "_h"], "starts array<int>, ends array<int>, items array<string>", searcher(shared)).where("size(starts) > 0")
        hits = part if hits is None else hits.unionByName(part)
        if not begun and (index := next(rest, None)) is not None:
            begun.append(index)
    # a repeated row brings the same spans again
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))))
    united = hits.groupBy("doc_id", "_h").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(acc, s):
        fresh = F.greatest(F.lit(0), s["ends"] - F.greatest(acc["to"], s["starts"].cast("long")))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["to"], s["ends"].cast("long")).alias("to"))

    hit = F.aggregate("spans", zero, add, lambda acc: acc["n"])
    united = united.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), hit.alias("_hit"), F.size("items").cast("long").alias("_items"), F.sha2(F.array_join("items", ","), 256).alias("_sha"))
    own = [c for c in carry if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    base = by_text(docs.select(*dict.fromkeys([*own, "doc_id", "text"]), text_hash.alias("_h")), [*dict.fromkeys([*own, "doc_id"]), "_h"], "n_words long", lambda: lambda batch: [[len(words(t)) for t in batch]])
    joined = base.join(united, base["doc_id"].eqNullSafe(united["_id"]) & base["_h"].eqNullSafe(united["_k"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(*own, "n_words", F.coalesce("_hit", zero).alias("n_hit"), F.coalesce("_items", zero).alias("n_items"), F.coalesce("_sha", F.lit(_digest([]))).alias("items_sha256"), (F.coalesce("_hit", zero) > 0).alias("contaminated"))
