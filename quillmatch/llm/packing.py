"""Packing into sequences of a fixed length by cutting-stock column generation.

A document of n tokens is cut into whole sequences and a remainder. Remainders are counted in bins
of `width` tokens; that histogram (at most length/width rows) is all that the driver sees. A linear
program over patterns, each a multiset of bins that fits a sequence, asks for the fewest sequences.
Its columns are generated: the duals price the bins, a knapsack dynamic program finds the most
valuable patterns, and generation ends when none is worth more than a sequence or the bound is
within `gap`. Patterns are rounded down, then up where demand remains, and the program is solved
anew for what is left over until no pattern fits into that. Documents are ranked within their bin (the rank within a task plus the ranks of the
tasks before it), and a rank's place among the patterns gives the sequence. Offsets are running
sums within a sequence.

Defined results: a null text is empty; every document has its closing id, so none has no tokens;
repeated rows are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.plans.staging import staged

from .common import arrow_schema, bounded_batches, id_type, slices, texts

LENGTH = 4096
WIDTH = 8
CLOSING_ID = 2
#: Column generation ends at this share above its lower bound.
GAP = 2e-4
#: Ids of whole sequences start here; those of packed remainders are below.
WHOLE = 1 << 58


#: The one normalizer and pre-tokenizer whose work on simple text is done here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: Stands between the ids of words; ids below 2**16 never give these bytes, in any alignment.
_BREAK = b"\xff" * 4


class Remembered:
    """A dictionary of two generations: when the young one holds `room` entries it becomes the old
    one, and what is asked for again moves back. It holds at most 2 * room entries."""

    def __init__(self, make, room: int):
        self.make, self.room, self.young, self.old = make, room, {}, {}

    def __call__(self, *lists: list) -> dict:
        """A dictionary that has all the keys of the lists; `make` fills in those that are new."""
        young = self.young
        keys = set().union(*lists)
        new = keys.difference(young)
        if new:
            if len(young) + len(new) > self.room:
                self.old, self.young = young, {}
                young, new = self.young, keys
            old = self.old
            young.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in young]
            young.update(zip(new, self.make(new), strict=True))
        return young


class WordEncoder:
    """Ids of texts by a tokenizer that never merges over white space. Ids of words (runs without
    ASCII white space) are remembered, a bounded number of them, as are those of pre-tokens.

    Where the tokenizer normalizes and pre-tokenizes in the one way that is known here and its
    merges end words by a suffix, words of code points below 0x300 (NFC leaves them as they are)
    that hold no special token are lower-cased and parted here and the merges alone are left to
    the tokenizer's model; all other words go through the tokenizer as a whole."""

    def __init__(self, path: str, closing: int, room: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.array([closing], dtype="<u4").tobytes()
        self.known = Remembered(self._words, room)
        parts = json.loads(self.tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        self.simple = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _PRE_TOKENIZER and parts["model"]["type"] == "BPE" and bool(suffix) and self.tokenizer.get_vocab_size() < 1 << 16
        if not self.simple:
            return
        special = "".join(f"|{re.escape(x['content'])}" for x in parts["added_tokens"])
        self.odd = re.compile(f"[^\x00-\u02ff]{special}")
        letters, numbers = (_category(kind) for kind in "LN")
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+|\n")
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in parts["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # the byte-level alphabet: printable bytes stand for themselves
        other = iter(range(256, 512))
        self.alphabet = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(other)) for b in range(256)} | {32: " "}
        self.parts = Remembered(self._parts, room)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-cased pre-tokens, each of which ends with its only token that has the suffix;
        a line break's is the mark between words."""
        if "\n" in parts:
            at = parts.index("\n")
            found = self._parts(parts[:at] + parts[at + 1 :])
            return [*found[:at], _BREAK, *found[at:]]
        if not parts:
            return []
        line = " ".join(parts).encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        at = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *at], at)]  # noqa: B905  the last end closes

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _simple_words(self, words: list[str]) -> list[bytes]:
        """All words are parted in one go; a line break, which no word holds, closes each."""
        parts = self.pattern.findall("\n".join([*words, ""]).lower())
        known = self.parts(parts)
        return b"".join(map(known.__getitem__, parts)).split(_BREAK)[:-1]

    def _words(self, words: list[bytes]) -> list[bytes]:
        plain = b"\n".join(words).decode()
        if self.simple and not self.odd.search(plain):
            return self._simple_words(plain.split("\n")) if words else []
        plain = plain.split("\n")
        odd = [w for w in plain if not self.simple or self.odd.search(w)]
        out = dict(zip(odd, self._whole(odd), strict=True))
        rest = [w for w in plain if w not in out]
        if rest:
            out.update(zip(rest, self._simple_words(rest), strict=True))
        return [out[w] for w in plain]

    def __call__(self, batch: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the closing one included."""
        parted = [text.split() if text else [] for text in batch]
        known = self.known(*parted)
        return [b"".join(map(known.__getitem__, words)) + self.closing for words in parted]


def _category(kind: str) -> str:
    """The code points below 0x300 of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)


#: A worker process keeps its encoders from task to task.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, closing: int) -> WordEncoder:
    if (path, closing) not in _ENCODERS:
        _ENCODERS[path, closing] = WordEncoder(path, closing)
    return _ENCODERS[path, closing]


def generate(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Patterns {size: count} of total at most capacity, and how often the relaxed program uses
    each; their demand is met. Revised simplex with an explicit inverse, which begins with the
    patterns of _greedy(). A knapsack table yields the best pattern with each size; those worth
    more than a sequence wait in a pool, which is priced anew for each pivot, and the knapsack is
    solved again when the pool holds nothing of worth."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    m = len(sizes)
    # a little more than the demand, so that no two ratios are equal and no pivot is in vain
    d = np.array([demand[s] for s in sizes.tolist()], dtype=float) + 1e-9 * (1 + np.arange(m) / m)
    material = float((sizes * d).sum()) / capacity
    basis = _greedy(sizes, d, capacity)
    inverse = np.linalg.inv(basis.T)
    x = np.maximum(inverse @ d, 0)
    pool = np.zeros((0, m))
    while x.sum() > (1 + gap) * material:
        duals = inverse.sum(axis=0)
        worth = pool @ duals
        if not len(pool) or worth.max() <= 1 + 1e-7:
            best, pool = _knapsack(sizes, duals, capacity)
            if best <= 1 + 1e-7 or x.sum() * (1 - 1 / best) <= gap * x.sum():
                break
            worth = pool @ duals
        a = pool[int(worth.argmax())]
        u = inverse @ a
        up = np.flatnonzero(u > 1e-9)
        r = up[int(np.argmin(x[up] / u[up]))]
        step = x[r] / u[r]
        x = np.maximum(x - step * u, 0)
        x[r] = step
        row = inverse[r] / u[r]
        u[r] = 0
        inverse -= np.outer(u, row)
        inverse[r] = row
        basis[r] = a
    return [({int(sizes[i]): int(c[i]) for i in np.flatnonzero(c)}, float(v)) for c, v in zip(basis, x, strict=True)]


def _greedy(sizes: np.ndarray, d: np.ndarray, capacity: int) -> np.ndarray:
    """A first basis, a pattern in each row: the largest size that is left, with the other sizes
    left that fill the sequence most, is used as often (also in parts) as the demand of one of its
    sizes lasts. Each pattern ends one size, so that together they are triangular."""
    left, rows = d.copy(), []
    live = np.ones(len(sizes), dtype=bool)
    while live.any():
        top = int(np.flatnonzero(live)[-1])
        row = np.zeros(len(sizes))
        row[top] = 1
        room = capacity - int(sizes[top])
        for i, n in _fill({int(i): (int(sizes[i]), capacity) for i in np.flatnonzero(live)}, room).items():
            row[i] += n
        used = np.flatnonzero(row)
        ends = used[int(np.argmin(left[used] / row[used]))]
        left = np.maximum(left - left[ends] / row[ends] * row, 0)
        live[ends] = False
        rows.append(row)
    return np.array(rows)


def _fill(sizes: dict, room: int) -> Counter:
    """Of sizes {name: (size, number)} those that fill the room most, larger ones first."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1  # a bit for each total that can be reached
    for name, (s, most) in sorted(sizes.items(), key=lambda x: -x[1][0]):
        for _ in range(min(most, room // s)):
            wider = (reach | reach << s) & mask
            if wider == reach:
                break
            steps.append((name, s, reach))
            reach = wider
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, Counter()
    for name, s, before in reversed(steps):
        if not before >> total & 1:
            out[name] += 1
            total -= s
    return out


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int, most: int = 64) -> tuple[float, np.ndarray]:
    """The greatest value of a multiset of sizes within capacity, and as rows the best multisets
    with each size, of those that are worth more than 1 the best `most`."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            worth = best[c - sizes[:n]] + value[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], took[c] = worth[k], k
    each = value + best[capacity - sizes]
    rows, size, took = {}, sizes.tolist(), took.tolist()
    for first in np.argsort(-each, kind="stable")[:most].tolist():
        if rows and each[first] <= 1 + 1e-7:
            break
        row = Counter([first])
        c = capacity - size[first]
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                row[took[c]] += 1
                c -= size[took[c]]
        rows[tuple(sorted(row.items()))] = None
    out = np.zeros((len(rows), len(sizes)))
    for i, row in enumerate(rows):
        for k, n in row:
            out[i, k] = n
    return float(best[capacity]), out


def _fullest_first(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Each sequence takes the largest size that is left and the others that fill it most."""
    left, used = Counter({s: n for s, n in left.items() if n > 0}), []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = Counter([top]) + _fill({s: (s, n) for s, n in left.items() if n > 0}, capacity - top)
        left[top] += 1
        times = min(left[s] // n for s, n in pattern.items())
        left = left - Counter({s: n * times for s, n in pattern.items()})
        used.append((dict(pattern), times))
    return used


def rounded(demand: dict[int, int], capacity: int, **settings) -> list[tuple[dict[int, int], int]]:
    """Patterns and whole numbers that meet the demand exactly: the relaxed program's, rounded
    down, then once more each by what was cut off, as far as demand remains. The program is then
    solved anew for the demand that is left, until none of its patterns fits into that; what
    remains, less than a sequence of each pattern, fills sequences largest first."""
    left = Counter({s: n for s, n in demand.items() if n > 0})
    used: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: int) -> bool:
        times = min([most, *(left[s] // n for s, n in pattern.items())])
        if times > 0:
            used.append((pattern, times))
            left.subtract({s: n * times for s, n in pattern.items()})
        return times > 0

    def full(pattern: dict[int, int]) -> bool:
        return sum(s * n for s, n in pattern.items()) >= 0.98 * capacity

    taken = True
    while taken:
        found = sorted(generate(left, capacity, **settings), key=lambda p: -p[1])
        taken = any([take(pattern, int(x + 1e-6)) for pattern, x in found if full(pattern)])
        taken |= any([take(pattern, 1) for pattern, x in sorted(found, key=lambda p: -(p[1] % 1)) if full(pattern)])
    return used + _fullest_first(left, capacity)


class Places:
    """The sequence and slot of each rank in each bin."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        next_rank: Counter = Counter()
        rows, base = [], 0
        for pattern, times in patterns:
            slot = 0
            for s, n in sorted(pattern.items(), reverse=True):
                rows.append(((s << 44) + next_rank[s], n, base, slot))
                next_rank[s] += n * times
                slot += n
            base += times
        rows.sort()
        self.key, self.n, self.base, self.slot = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (size << 44) + rank
        at = np.searchsorted(self.key, key, side="right") - 1
        past = key - self.key[at]
        return self.base[at] + past // self.n[at], self.slot[at] + past % self.n[at]


def cut(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, width: int = WIDTH, closing: int = CLOSING_ID) -> DataFrame:
    """A row for each document: its tokens, the checksums of its pieces, and its place within the
    task (part): the number of the first whole sequence, and the rank of the remainder in its bin."""
    ddl = f"doc_id {id_type(docs, 'doc_id')}, doc_tokens long, whole array<long>, first long, rest long, rest_crc long, bin long, part long, rank long"
    schema = arrow_schema(ddl)

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path, closing)
        ranks: Counter = Counter()
        first = part << 34
        step = 4 * length
        for batch in slices(it):
            rows = []
            for ids in encode(texts(batch)):
                n = len(ids) // 4
                k = n // length
                rest = n - k * length
                b = -(-rest // width)
                rows.append((n, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(k)], first, rest, zlib.crc32(ids[k * step :]) if rest else None, b, part, ranks[b]))
                ranks[b] += 1
                first += k
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, width: int = WIDTH, closing: int = CLOSING_ID, **settings) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    rows = staged(cut(docs, tokenizer_path, length, width, closing))
    rests = rows.where("rest > 0")
    # a row for each bin and task
    counts = rests.groupBy("bin", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("bin").alias("_bin"), F.col("part").alias("_part"), F.coalesce("before", F.lit(0)).alias("before"))
    demand = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most length/width rows
    places = rows.sparkSession.sparkContext.broadcast(Places(rounded(demand, length // width, **settings)))

    ranked = rests.join(before, (rests["bin"] == before["_bin"]) & (rests["part"] == before["_part"])).select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "bin", (F.col("rank") + F.col("before")).alias("rank"))
    ddl = f"doc_id {id_type(docs, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    schema = arrow_schema(ddl)

    def place(it):
        for batch in it:
            sequence, slot = places.value(batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], schema=schema)

    placed = ranked.mapInArrow(place, ddl)
    ahead = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")
    whole = rows.where(F.size("whole") > 0).select("doc_id", "doc_tokens", "first", F.posexplode("whole").alias("i", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("i") * F.lit(length)).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i") + F.lit(WHOLE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
