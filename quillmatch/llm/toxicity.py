"""Toxicity by class-conditional Kneser-Ney models.

Each class has a Kneser-Ney model of how its words are spelt: the probability of each character
(byte) of a word given the seven before it, within the word. A class's counts are the documents
that have a word, so that one document's favourite words weigh little; they stand at the highest
order only, less a discount of `CLASS_DISCOUNT`. Lower orders are continuation counts that both
classes share, so an expression that neither class has often gets much the same probability from
both. The leading evidence is the whole text's toxic less its ordinary log-likelihood by its
number of words. As a few words decide in a long text, it is compared at other lengths too, by the
words' evidence less its median over the text, which its language decides: the greatest mean over
any run of `RUNS` consecutive words, and what is above `FLOOR` summed over distinct words, as it is
and by the text's length. A logistic calibration of these, fitted on half of the sample with models
of the other half, gives the score.

The classifier is fitted on a bounded sample of labelled rows: per class, `per_class` documents at
most by the order of a hash, and of those as many as have `class_bytes` bytes of text together
(repeated rows count once, and of rows of one id with several texts a bounded number is looked at).
Every whole text is scored.

Defined results: a null text, or one without words, has no evidence and gets the prior of
calibration at zero, at most 0.5; rows whose label is null or neither 0 nor 1 are not learned from;
of several labels of a document the greatest holds; without labels of both classes every score is
0; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, id_type

ORDER = 8
DISCOUNT = 0.75
CLASS_DISCOUNT = 2.0
RUNS = (1, 4, 16)
FLOOR, CEILING = 2.0, 8.0
FEATURES = len(RUNS) + 4
PER_CLASS = 3000
CLASS_BYTES = 16_000_000
THRESHOLD = 0.7

#: Letters and all non-ASCII characters make words; A-Z are lower-cased.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def _grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of order ORDER of all words, one for each character and the word's end, and
    which word each belongs to."""
    pad = b" " * (ORDER - 1)
    raw = np.frombuffer(b"".join(pad + w + b" " for w in ws), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in ws], dtype=np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    owner = np.repeat(np.arange(len(ws)), sizes)
    ends = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    key = np.zeros(len(ends), dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(8)) | raw[ends - back]
    return key, owner


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _shared(top: np.ndarray) -> np.ndarray:
    """For each distinct n-gram of the highest order, what the shared lower orders give its last
    character: interpolated Kneser-Ney over numbers of distinct n-grams one order above."""
    levels = [top]
    for n in range(ORDER - 1, 0, -1):
        levels.append(np.unique(levels[-1] & np.uint64((1 << (8 * n)) - 1)))
    below_keys, below_p = None, None
    for n in range(1, ORDER):
        keys, above = levels[ORDER - n], levels[ORDER - n - 1]
        counts = np.bincount(np.searchsorted(keys, above & np.uint64((1 << (8 * n)) - 1)), minlength=len(keys)).astype(float)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(of, weights=counts)
        kinds = np.bincount(of)
        if below_p is None:
            lower = np.full(len(keys), 1 / 256)
        else:
            lower = below_p[np.searchsorted(below_keys, keys & np.uint64((1 << (8 * (n - 1))) - 1))]
        below_p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[of] * lower) / total[of]
        below_keys = keys
    return below_p[np.searchsorted(below_keys, top & np.uint64((1 << (8 * (ORDER - 1))) - 1))]


class Evidence:
    """Toxic less ordinary log-likelihood of words."""

    def __init__(self, toxic: Counter, ordinary: Counter):
        every = sorted(set(toxic) | set(ordinary))
        key, owner = _grams(every)
        self.keys, of = np.unique(key, return_inverse=True)
        lower = _shared(self.keys) if len(self.keys) else np.zeros(0)
        self.contexts, ctx = np.unique(self.keys >> np.uint64(8), return_inverse=True)
        value, weight = [], []
        for counts in (toxic, ordinary):
            c = np.bincount(of, weights=np.array([counts[w] for w in every], dtype=float)[owner], minlength=len(self.keys))
            total = np.bincount(ctx, weights=c, minlength=len(self.contexts))
            own = np.maximum(c - CLASS_DISCOUNT, 0) / np.maximum(total[ctx], 1)
            mass = np.where(total > 0, 1 - np.bincount(ctx, weights=own, minlength=len(self.contexts)), 1.0)
            value.append(np.log(own + mass[ctx] * lower))
            weight.append(np.log(mass))
        self.value, self.unseen = value[0] - value[1], weight[0] - weight[1]
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def of_words(self, ws: list[bytes]) -> np.ndarray:
        key, owner = _grams(ws)
        at, seen = _find(self.keys, key)
        ctx, known = _find(self.contexts, key >> np.uint64(8))
        each = np.where(seen, self.value[at], np.where(known, self.unseen[ctx], 0.0)) if len(self.keys) else np.zeros(len(key))
        return np.bincount(owner, weights=each, minlength=len(ws))

    def __call__(self, ws: list[bytes], room: int = 300_000, longest: int = 64) -> np.ndarray:
        """The evidence of each word. Up to `room` words of `longest` bytes are remembered, and when
        they are more, those that were met first are forgotten, but for half as many."""
        known = self.known
        new = [w for w in set(ws) if w not in known]
        if not new:
            return np.fromiter(map(known.__getitem__, ws), dtype=float, count=len(ws))
        fresh = dict(zip(new, self.of_words(new).tolist(), strict=True))
        found = np.fromiter((fresh[w] if w in fresh else known[w] for w in ws), dtype=float, count=len(ws))
        if len(known) > room:
            for w in list(islice(known, len(known) - room // 2)):
                del known[w]
        known.update((w, v) for w, v in fresh.items() if len(w) <= longest)
        return found

    def features(self, text: bytes | None) -> list[float]:
        """The mean over the whole text; less its median, the greatest mean over runs of each length;
        evidence above the floor, in sum (its logarithm) and by length; log of the length."""
        ws = words(text)
        if not ws:
            return [0.0] * FEATURES
        each = self(ws)
        whole = float(each.mean())
        each = each - np.median(each)
        total = np.concatenate([[0.0], np.cumsum(each)])
        n = len(ws)
        runs = [float((total[min(r, n) :] - total[: n + 1 - min(r, n)]).max()) / min(r, n) for r in RUNS]
        above = sum(dict(zip(ws, np.clip(each - FLOOR, 0, CEILING).tolist(), strict=True)).values())
        return [whole, *runs, float(np.log1p(above)), above / n, float(np.log(n))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights and intercept by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w


class Model:
    def __init__(self, sample: list[tuple[bytes | None, int]]):
        """sample: texts and labels, in an order that has nothing to do with either."""
        self.evidence = None
        if len({y for _, y in sample}) < 2:
            return
        ws = [words(t) for t, _ in sample]
        halves = [0, 0]
        half = []
        for _, y in sample:  # each class in turn to one half and the other
            half.append(halves[y] % 2)
            halves[y] += 1

        def fitted(parts):
            counts = (Counter(), Counter())
            for w, (_, y), h in zip(ws, sample, half, strict=True):
                if h in parts:
                    counts[y].update(set(w))
            return Evidence(counts[1], counts[0])

        # both halves are scored by the models of the other
        x = np.zeros((len(sample), FEATURES))
        for h in (0, 1):
            other = fitted({1 - h})
            for i, (t, _) in enumerate(sample):
                if half[i] == h:
                    x[i] = other.features(t)
        y = np.array([y for _, y in sample], dtype=float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = logistic((x - self.mean) / self.scale, y)
        self.evidence = fitted({0, 1})

    def __call__(self, text: bytes | None) -> float:
        if self.evidence is None:
            return 0.0
        x = (np.array(self.evidence.features(text)) - self.mean) / self.scale
        p = float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))
        return p if text and words(text) else min(p, 0.5)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, label: str = "toxic") -> list[tuple[bytes | None, int]]:
    """Texts and labels (of the column `label`) of the bounded sample; `learn` is a condition on
    doc_id."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("toxic")).where(learn & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = marked.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # twice per_class ids at most
    ids = [(r["doc_id"], r["toxic"]) for r in picked.collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    kind = f"_id {id_type(labels, 'doc_id')}, _toxic int"
    rows = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, kind)), F.col("doc_id") == F.col("_id"))
    key = F.xxhash64("text").alias("key")
    sizes = rows.groupBy("doc_id", "_toxic", key).agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).withColumn("o", order)
    total, chosen = [0, 0], []
    for r in sizes.orderBy("o", "doc_id", "key").limit(4 * per_class).collect():
        if total[r["_toxic"]] + r["n"] <= class_bytes:
            total[r["_toxic"]] += r["n"]
            chosen.append((r["doc_id"], r["_toxic"], r["key"]))
    if not chosen:
        return []
    picked = F.broadcast(spark.createDataFrame(chosen, f"{kind}, _key long"))
    texts_of = docs.select("doc_id", "text", key).join(picked, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")))
    texts_of = texts_of.groupBy("doc_id", "_toxic", "key").agg(F.min(F.col("text").cast("binary")).alias("text")).withColumn("o", order)
    found = [(r["o"], r["doc_id"], r["key"], None if r["text"] is None else bytes(r["text"]), r["_toxic"]) for r in texts_of.collect()]
    return [(t, y) for *_, t, y in sorted(found, key=lambda r: r[:3])]


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. held_out is a condition on
    doc_id; documents for which it is true are not learned from."""
    model = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels, ~F.coalesce(held_out, F.lit(True)), **bounds)))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def make():
        def judge(batch):
            found = [model.value(t) for t in batch]
            return [found, [int(p >= threshold) for p in found]]

        return judge

    return by_text(rows, ["doc_id", "held_out"], "score double, predicted int", make)
