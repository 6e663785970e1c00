"""Language-model scoring by a probabilistic suffix tree over words.

A text's tokens are its words (parted by ASCII white space, A-Z lower-cased) and one end. The tree
holds contexts of up to two words. A context is a candidate if it occurs at least `min_context`
times in the training tokens and its suffix is retained; n-grams that occur at least `min_symbol`
times are its explicit next symbols. Both are counts, so that what is gathered grows with the
corpus. A candidate is retained if its next-symbol distribution diverges from that of its suffix:
its count times their relative entropy is at least `divergence` times its number of explicit next
symbols.

Smoothing: a state s gives an explicit next symbol (count(s, x) - d) / count(s) and the mass it
leaves over times what its suffix gives; the root gives a known word (count - d) / N and all
unknown words together the rest, d times the known types over N. So each state's distribution over
the known words and "unknown" sums to 1. A text's score is the sum of log10 probabilities, each
token in the state of the longest suffix of its history (a start mark opens each text).

Counted on 27 million tokens of prose in four languages, a third of whose distinct words are seen
three times: 53 percent of the places hold a frequent enough pair of words, 22 percent three such
words, before the divergence test; all other places take what the root gives to the word.

Words and n-grams are named by 64-bit hashes. N-grams are counted in windows of a task's tokens,
whose counts go as packed arrays to buckets by hash, so that a bucket is summed up in one go; there
are as many buckets as keep one small at any corpus size. Bitmaps of bounded size (`bitmap_bits`)
keep back n-grams whose context or suffix is too rare for them to matter.

The logarithm of a token's probability is a sum of weights: of the word, of its history as states
(what they leave over), and of the n-grams that are explicit in them (what they give beyond that).
So the tree is a table of weights by word and n-gram, and scoring is one join with it. Weights of
the `head` most frequent entries or fewer are broadcast (24 bytes each, whatever the corpus); all
others are joined. A bitmap keeps back most n-grams that have no weight; those it lets through find
nothing in the join.

Defined results: a null text is empty, its one token is the end; without training texts every
count is 0 and the tree is its root alone, which gives an unknown token probability 1. Repeated
rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.staging import release, staged, unstage

from .common import LOWER, arrow_schema, bounded_batches, hashed_words, id_type, mix, slices, texts, word_hashes

#: The end's name among the words: no word holds a line break.
END = b"\n"

#: An n-gram of a collected tree is packed in 63 bits: up to three symbols.
_BITS = 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: N-grams of so many tokens are counted together in a task.
WINDOW = 1_000_000
#: Training tokens for each bucket of n-gram counts.
PER_BUCKET = 1 << 16


@dataclass(frozen=True)
class Settings:
    """See the module. Thresholds from 1 on are counts, those below are shares of the training
    tokens (which bound what is retained at any corpus size)."""

    depth: int = 2
    min_symbol: float = 3
    min_context: float = 8
    divergence: float = 2.0
    discount: float = 0.75
    head: int = 500_000
    bitmap_bits: int = 28

    def __post_init__(self):
        if not 1 <= self.depth <= 2:
            raise ValueError("contexts have one or two words")

    def least(self, threshold: float, n: int) -> int:
        return max(2, math.ceil(threshold * n if threshold < 1 else threshold))


def tokens(text: bytes | None) -> list[bytes]:
    out = text.translate(LOWER).split() if text else []
    out.append(END)
    return out


#: The start mark's and the end's hash; no word holds white space.
_START, _END = (word_hashes([b" "])[0], word_hashes([END])[0])


def _long(h: np.uint64) -> int:
    return int(h.view(np.int64))


def joined_hash(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, of those of its context and of its suffix (or last word)."""
    return mix(context * _STEP + last)


def hashed(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of texts in a row, each opened by the start mark, and the size of
    each text with its start mark."""
    h, n = hashed_words(batch)
    first = np.cumsum(n + 2) - n - 2
    out = np.empty(len(h) + 2 * len(batch), dtype=np.uint64)
    out[first] = _START
    out[first + n + 1] = _END
    out[np.arange(len(h)) + 2 * np.repeat(np.arange(len(batch)), n) + 1] = h
    return out, n + 2


def windows(it):
    """Token hashes of batches, so many tokens together."""
    held, n = [], 0
    for batch in slices(it):
        held.append(hashed(texts(batch))[0])
        n += len(held[-1])
        if n >= WINDOW:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def hash_counts(train: DataFrame) -> DataFrame:
    """h long, c long: of all training tokens, and of the start mark."""
    ddl = "h long, c long"
    schema = arrow_schema(ddl)

    def run(it):
        for h in windows(it):
            h, c = np.unique(h, return_counts=True)
            whole = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=schema)
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)

    return train.select("text").mapInArrow(run, ddl).groupBy("h").agg(F.sum("c").alias("c"))


def word_counts(train: DataFrame) -> DataFrame:
    """word binary, c long: of all training tokens."""
    ddl = "word binary, c long"
    schema = arrow_schema(ddl)

    def run(it):
        for batch in slices(it):
            total = Counter(w for text in texts(batch) for w in tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip((total, total.values()), schema, strict=True)], schema=schema)

    return train.select("text").mapInArrow(run, ddl).groupBy("word").agg(F.sum("c").alias("c"))


def hashed_grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the two words and of the three words that end at each place, and whether they lie in
    one text; the three words' context and suffix are the two words before and here."""
    two, three = np.zeros_like(h), np.zeros_like(h)
    start = h == _START
    has2, has3 = ~start, ~start
    two[1:] = joined_hash(h[:-1], h[1:])
    three[1:] = joined_hash(two[:-1], two[1:])
    has3[1:] &= ~start[:-1]
    has2[:1] = has3[:1] = False
    return two, has2, three, has3


def bitmap(keys: DataFrame, most_bits: int) -> tuple[int, np.ndarray]:
    """The bits of a blocked filter over `keys` (a column f), log2 of their number and the bytes. It
    has 64 parts by the key's top bits, so that each part is made in one place."""
    n = keys.count()
    bits = min(most_bits, max(12, math.ceil(math.log2(max(n, 1) * 12))))
    ddl = "part int, bits binary"
    schema = arrow_schema(ddl)

    def run(it):
        parts: dict[int, np.ndarray] = {}
        for batch in it:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = (x >> np.uint64(58)).astype(np.int64)
            for p in np.unique(part).tolist():
                own = parts.setdefault(p, np.zeros(1 << (bits - 6), dtype=bool))
                for at in places(x[part == p], bits):
                    own[(at & np.uint64((1 << (bits - 6)) - 1)).astype(np.int64)] = True
        for p, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], type=pa.binary())], schema=schema)

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = len(out) // 64
    for r in keys.select("f").repartition(F.shiftrightunsigned("f", 58)).mapInArrow(run, ddl).toLocalIterator():
        out[r["part"] * size : (r["part"] + 1) * size] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bits, out


def places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each key: its part, and two places there."""
    part = (x >> np.uint64(58)) << np.uint64(bits - 6)
    within = np.uint64((1 << (bits - 6)) - 1)
    return [part | (x & within), part | ((x >> np.uint64(29)) & within)]


def maybe(x: np.ndarray, filled: tuple[int, np.ndarray]) -> np.ndarray:
    bits, data = filled
    out = np.ones(len(x), dtype=bool)
    for at in places(x, bits):
        out &= (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def gram_counts(train: DataFrame, order: int, least: int, n: int, contexts, suffixes) -> DataFrame:
    """f, ctx, short, c of the n-grams of `order` words that occur `least` times: their hash, and
    those of the context and of the suffix. `contexts`, `suffixes`: broadcast bitmaps of those
    that matter; `n`: the training tokens."""
    bits = max(6, math.ceil(math.log2(max(n / PER_BUCKET, 1))))
    ddl = "bucket long, ctx binary, short binary, c binary"
    schema = arrow_schema(ddl)

    def count(it):
        for h in windows(it):
            at = np.flatnonzero(h != _START)
            if order == 3:
                at = at[h[at - 1] != _START]
                h = np.concatenate([h[:1], joined_hash(h[:-1], h[1:])])  # of the two words that end here
            at = at[maybe(h[at - 1], contexts.value)]
            at = at[maybe(h[at], suffixes.value)]
            ctx, short = h[at - 1], h[at]
            del h, at  # a window's arrays are most of a worker's memory
            f, first, c = np.unique(joined_hash(ctx, short), return_index=True, return_counts=True)
            ctx, short, c = ctx[first], short[first], c.astype(np.uint32)
            bucket = f >> np.uint64(64 - bits)
            own, begin = np.unique(bucket, return_index=True)
            ends = [*begin[1:].tolist(), len(f)]
            for i in range(0, len(own), 64):
                cut = list(zip(begin[i : i + 64].tolist(), ends[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 64].view(np.int64)), *(pa.array([x[a:b].tobytes() for a, b in cut], type=pa.binary()) for x in (ctx, short, c))], schema=schema)

    sums = arrow_schema("f long, ctx long, short long, c long")

    def summed(held: list[tuple]) -> pa.RecordBatch:
        ctx, short = (np.frombuffer(b"".join([r[i] for r in held]), dtype=np.uint64) for i in (1, 2))
        c = np.frombuffer(b"".join([r[3] for r in held]), dtype=np.uint32).astype(np.int64)
        f = joined_hash(ctx, short)
        order = np.argsort(f)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(f[order]) > 0]))
        total = np.add.reduceat(c[order], begin)
        at = order[begin[total >= least]]
        return pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (f, ctx, short)), pa.array(total[total >= least])], schema=sums)

    def run(it):
        held: list[tuple] = []  # of one bucket
        for batch in it:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield summed(held)
                    held = []
                held.append(row)
        if held:
            yield summed(held)

    packed = train.select("text").mapInArrow(count, ddl)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "f long, ctx long, short long, c long")


def grow(grams: DataFrame, totals: DataFrame, lower: DataFrame, s: Settings) -> DataFrame:
    """f, ctx, short, c, lower, logp, left of the explicit n-grams of the states of one depth. `grams`
    are counted n-grams, `totals` (ctx, total) the candidates, `lower` (short, lower) what their
    suffix gives to the same symbols."""
    d = F.lit(s.discount)
    sums = grams.groupBy("ctx").agg(F.sum(F.col("c") - d).alias("held"), F.count("*").alias("k"), F.sum("c").alias("seen")).join(totals, "ctx")
    rest = F.greatest(1 - F.col("held") / F.col("total"), F.lit(1e-12))
    sums = sums.select("ctx", "total", "k", "seen", rest.alias("rest"))
    rows = staged(grams.join(sums, "ctx").join(lower, "short").withColumn("p", (F.col("c") - d) / F.col("total") + F.col("rest") * F.pow(F.lit(10.0), "lower")))
    # divergence: explicit symbols one by one, the rest by the mass that is left over
    gain = F.sum(F.col("c") * (F.log("p") - F.col("lower") * math.log(10)))
    gain = gain + F.greatest(F.max("total") - F.max("seen"), F.lit(0)) * F.log(F.max("rest"))
    retained = rows.groupBy("ctx").agg(gain.alias("gain"), F.max("k").alias("k")).where(F.col("gain") >= s.divergence * F.col("k")).select("ctx")
    out = staged(rows.join(retained, "ctx", "left_semi").select("f", "ctx", "short", "c", "lower", F.log10("p").alias("logp"), F.log10("rest").alias("left")))
    unstage(rows)
    return out


@dataclass
class Grown:
    """Words (h, c; the start mark among them) and the explicit n-grams of each depth."""

    n: int
    types: int
    words: DataFrame
    depths: list[DataFrame]


def grown(train: DataFrame, s: Settings) -> Grown:
    spark = train.sparkSession
    words = staged(hash_counts(train))
    release(spark)
    n, types = words.where(F.col("h") != _long(_START)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    out = Grown(n, types, words, [])
    if not n:
        return out
    least, context = s.least(s.min_symbol / 4 if s.min_symbol < 1 else s.min_symbol, n), s.least(s.min_context, n)
    totals = words.where(F.col("c") >= context).select(F.col("h").alias("ctx"), F.col("c").alias("total"))
    lower = words.select(F.col("h").alias("short"), F.log10((F.col("c") - s.discount) / F.lit(float(n))).alias("lower"))
    shorts = words.where(F.col("c") >= least).select(F.col("h").alias("short"))
    for order in range(2, s.depth + 2):
        shared = [spark.sparkContext.broadcast(bitmap(x.select(F.col(c).alias("f")), s.bitmap_bits)) for x, c in ((totals, "ctx"), (shorts, "short"))]
        found = staged(gram_counts(train, order, least, n, *shared))
        for x in shared:
            x.destroy()
        release(spark)
        out.depths.append(grow(found, totals, lower, s))
        unstage(found)
        release(spark)
        # a context is a candidate only with its suffix: the explicit n-grams of a state
        totals = out.depths[-1].where(F.col("c") >= context).select(F.col("f").alias("ctx"), F.col("c").alias("total"))
        lower = out.depths[-1].select(F.col("f").alias("short"), F.col("logp").alias("lower"))
        shorts = lower
    return out


def weights(g: Grown, s: Settings) -> DataFrame:
    """f long, c long, weight double, base double: of each word and n-gram; those of words are what
    they have beyond an unknown one. base is over 0 for words alone."""
    unknown = _unknown(g, s)
    own = F.log10((F.col("c") - s.discount) / F.lit(float(max(g.n, 1)))) - F.lit(unknown)
    word = F.col("h") != F.lit(_long(_START))
    parts = [g.words.select(F.col("h").alias("f"), "c", F.when(word, own).otherwise(0.0).alias("weight"), F.when(word, F.log10(F.col("c") + 1)).otherwise(0.0).alias("base"))]
    zero = [F.lit(0.0).alias("base")]
    for rows in g.depths:
        parts.append(rows.select("f", "c", (F.col("logp") - F.col("lower") - F.col("left")).alias("weight"), *zero))
        # what a state leaves over, by its own hash; its count comes with the word or n-gram
        parts.append(rows.groupBy("ctx").agg(F.max("left").alias("weight")).select(F.col("ctx").alias("f"), F.lit(0).cast("long").alias("c"), "weight", *zero))
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("f").agg(F.max("c").alias("c"), F.sum("weight").alias("weight"), F.sum("base").alias("base"))


def _unknown(g: Grown, s: Settings) -> float:
    return math.log10(s.discount * g.types / g.n) if g.n else 0.0


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def grams(ids: np.ndarray, start: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed context of order-1 symbols before each token, -1 where one of them is not explicit
    or lies before the start mark; and the token."""
    context = np.zeros(len(ids), dtype=np.int64)
    bad = np.zeros(len(ids), dtype=bool)
    for back in range(order - 1, 0, -1):
        before = np.zeros(len(ids), dtype=np.int64)
        before[back:] = ids[:-back]
        if back <= len(ids):
            before[back - 1] = start
        bad |= before == 0
        context = (context << _BITS) | before
    return np.where(bad, -1, context), ids


@dataclass
class Tree:
    """States sorted by packed context, for each depth: the log10 of the mass left to the suffix,
    and the explicit next symbols as sorted packed n-grams with their log10 probability."""

    n: int
    types: int
    discount: float
    symbols: dict[bytes, int]
    counts: np.ndarray  # of each symbol
    states: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    explicit: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    start: int = 0

    def root(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c - self.discount) / self.n) if self.n else np.zeros(len(c))

    def score(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the log10 probability but for the root's share of tokens that are not
        explicit symbols; and whether that share is to be added."""
        value, rest = np.zeros(len(ids)), np.ones(len(ids), dtype=bool)
        for order in range(len(self.states) + 1, 1, -1):
            context, last = grams(ids, self.start, order)
            contexts, left = self.states[order - 2]
            keys, logp = self.explicit[order - 2]
            inside = rest & member(context, contexts)
            gram = (context << _BITS) | last
            known = inside & (last > 0) & member(gram, keys)
            value[known] += logp[np.searchsorted(keys, gram[known])]
            rest &= ~known
            down = inside & ~known
            value[down] += left[np.searchsorted(contexts, context[down])]
        own = rest & (ids > 0)
        value[own] += self.root(self.counts[ids[own]])
        return value, rest & (ids == 0)


def fit(train: DataFrame, counts: DataFrame, s: Settings = Settings()) -> Tree:
    """The tree of a small corpus on the driver; `counts` are the word counts of the texts."""
    g = grown(train, s)
    names = sorted(counts.collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    ids = {_long(h): i + 1 for i, h in enumerate(word_hashes([bytes(r["word"]) for r in names]))} if names else {}
    tree = Tree(g.n, g.types, s.discount, {bytes(r["word"]): i + 1 for i, r in enumerate(names)}, np.array([0, *(r["c"] for r in names)], dtype=np.int64), start=len(names) + 1)
    assert tree.start < 1 << _BITS
    ids[_long(_START)] = tree.start
    packed = dict(ids)  # words and n-grams by hash
    for rows in g.depths:
        found = rows.collect()
        mask = (1 << _BITS) - 1
        packed = packed | {r["f"]: (packed[r["ctx"]] << _BITS) | (packed[r["short"]] & mask) for r in found}
        states = sorted({(packed[r["ctx"]], r["left"]) for r in found})
        explicit = sorted((packed[r["f"]], r["logp"]) for r in found)
        for out, of in ((tree.states, states), (tree.explicit, explicit)):
            out.append((np.array([k for k, _ in of], dtype=np.int64), np.array([v for _, v in of], dtype=float)))
    return tree


def _head(table: DataFrame, most: int) -> int:
    """The least count of the broadcast entries, `most` at most: by a table of how many entries have
    each count, which has few rows (distinct counts) but is cut off anyway."""
    by = table.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c"))
    total, least = 0, 0
    for r in by.limit(100_000).collect():
        total += r["k"]
        if total > most:
            return least or r["c"] + 1
        least = r["c"]
    return max(least, 1)


def score(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Rows for which held_out is true are scored but not learned from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    bounded_batches(spark)
    g = grown(train, s)
    n = g.n
    table = staged(weights(g, s))
    for x in (g.words, *g.depths):
        unstage(x)
    release(spark)
    least = _head(table, s.head)
    tail = table.where(F.col("c") < least)
    head = table.where(F.col("c") >= least).select("f", "weight", "base").toArrow().sort_by("f")
    head = {c: head[c].to_numpy() for c in ("f", "weight", "base")}
    shared = spark.sparkContext.broadcast(head | {"tail": bitmap(tail, s.bitmap_bits)})
    del head
    unknown, base0 = _unknown(g, s), -math.log10(n + g.types + 1)
    kind = id_type(docs, "doc_id")
    # A text gives a row with what the head decides, under a name of its own, and a row for each
    # word and n-gram that the tail may hold.
    ddl = f"row long, f long, tf long, doc_id {kind}, held_out boolean, n_tokens long, n_known double, base double, value double"
    schema = arrow_schema(ddl)

    def emit(it):
        from pyspark import TaskContext

        t = shared.value
        row = TaskContext.get().partitionId() << 33
        for part in slices(it):
            yield from pieces(part, row, *hashed(texts(part)), t)
            row += part.num_rows

    def pieces(batch, row, h, size, t):
        docs_n = batch.num_rows
        two, has2, three, has3 = hashed_grams(h)
        of = np.repeat(np.arange(docs_n), size)
        of = np.concatenate([of, of[has2], of[has3]])
        key, back = np.unique(np.concatenate([h, two[has2], three[has3]]).view(np.int64), return_inverse=True)
        inside = member(key, t["f"])
        at = np.searchsorted(t["f"], key[inside])
        weight, base, open_ = np.zeros(len(key)), np.zeros(len(key)), ~inside
        weight[inside], base[inside] = t["weight"][at], t["base"][at]
        open_[~inside] = maybe(key[~inside].view(np.uint64), t["tail"])
        known, base, value = (np.bincount(of, weights=x[back], minlength=docs_n) for x in (base > 0, base, weight))
        total = size - 1
        own = np.arange(row, row + docs_n, dtype=np.int64)
        blank = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mix(own.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(docs_n, dtype=np.int64)), batch.column(0), batch.column(2), *(pa.array(x) for x in (total, known, base + total * base0, value + total * unknown))], schema=schema)
        at = np.flatnonzero(open_[back])
        # by text, then by n-gram
        pair, tf = np.unique(of[at] * len(key) + back[at], return_counts=True)
        of, key = pair // max(len(key), 1), key[pair % max(len(key), 1)]
        for a in range(0, len(pair), 100_000):
            i = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(own[of[i]]), pa.array(key[i]), pa.array(tf[i]), *(blank(len(of[i]), x.type) for x in list(schema)[3:])], schema=schema)

    parts = rows.mapInArrow(emit, ddl)
    of = tail.select(F.col("f").alias("_f"), F.col("weight").alias("_weight"), F.col("base").alias("_base"), (F.col("base") > 0).cast("int").alias("_known"))
    joined = parts.join(of, parts["f"] == of["_f"], "left")
    more = {c: F.sum(F.col("tf") * F.coalesce(F.col(c), F.lit(0))) for c in ("_known", "_base", "_weight")}
    sums = joined.groupBy("row").agg(
        F.max(F.struct(F.col("n_tokens").isNotNull().alias("own"), "doc_id", "held_out", "n_tokens", "n_known", "base", "value")).alias("own"),
        *(x.alias(c) for c, x in more.items()),
    )
    return sums.select(
        "own.doc_id",
        "own.held_out",
        "own.n_tokens",
        (F.col("own.n_known") + F.col("_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.col("_base")).alias("base_score"),
        (F.col("own.value") + F.col("_weight")).alias("score"),
    )
