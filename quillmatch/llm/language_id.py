"""Language identification by hierarchical discrimination.

A text's features are its hashed byte bigrams and trigrams (letters only, A-Z lower-cased, all
else one space), square-rooted and scaled to length one. A text first goes to a language family,
by one-versus-one linear support vector machines between families; then one-versus-one machines
between the languages of that family decide. A language that isn't in FAMILIES is a family of its
own; where there are more than `MOST` families, those of similar features are put together, eight
at each step, and a text goes down step by step, so that L languages need about 4 L machines. The
winner of a vote has most pairs, and among equals the largest sum of margins. The score is the
product, over all steps, of the least probability that the winner has against any other.

The machines (squared hinge) are trained on a bounded sample of labelled rows: per language
`per_language` documents at most by the order of a hash of id and text (repeated rows count once), of
those as many as have `language_bytes` bytes together, and at most `total` documents and
`total_bytes` bytes that the languages share equally, but `least` documents of each language at
least. The driver holds the sample's nonzero features, and 32 KB for each machine. Every language that a row is labelled with is learned. Besides each sampled
text itself a short run out of its middle is learned from, so that short texts are known too.
Every whole text is judged.

Defined results: `und` with score 0 for a null text, for one without a letter, and for all where
nothing was learned; a null lang is not learned from; where one language alone was learned, it gets
score 1; repeated rows are judged one by one; other columns are
ignored, or carried on as asked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, columns_of

BUCKETS = 1 << 13
PER_LANGUAGE = 400
LANGUAGE_BYTES = 4_000_000
#: Documents of all languages together; several languages share them equally, with so many each at least.
TOTAL = 1600
LEAST = 8
#: Bytes of all languages together, shared equally too.
TOTAL_BYTES = 16_000_000
#: Families that are told apart in one step; beyond that they are put together, into so many groups.
MOST, GROUPS = 12, 8
#: Rows of one side of a machine, shared by its languages; and rows up to which it works on their products.
SIDE, FEW = 1600, 512

#: Families of languages by code; a language that isn't listed is its own family.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "oc": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "mk": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}

#: ASCII letters (A-Z lower-cased) and non-ASCII bytes stay, all else becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    kept = text.translate(_LETTERS)
    if kept.isspace():
        return False
    return any(97 <= b <= 122 for b in kept[:64]) or any(c.isalpha() for c in text.decode())


def features(text: bytes) -> np.ndarray:
    kept = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    x = np.frombuffer(kept, dtype=np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:] * np.uint32(7919) + np.uint32(1)
    two = (two * np.uint32(0x9E3779B1)) >> np.uint32(19)
    three = (three * np.uint32(0x85EBCA77)) >> np.uint32(19)
    counts = np.bincount(two, minlength=BUCKETS)[:BUCKETS] + np.bincount(three, minlength=BUCKETS)[:BUCKETS]
    out = np.sqrt(counts).astype(np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, y is 1 or -1; each class
    weighs as much as the other. Accelerated gradient steps; of few rows on their products with each
    other, as the weights are sums of rows throughout."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    weight = weight.astype(np.float32)
    y = y.astype(np.float32)
    few = len(x) <= FEW
    products = x @ x.T if few else None
    w, b = np.zeros(len(x) if few else x.shape[1], dtype=np.float32), np.float32(0)
    v, vb = w.copy(), b
    rate = np.float32(1 / (1e-3 + 4 * cost))
    for t in range(1, steps + 1):
        short = np.maximum(1 - y * ((products if few else x) @ v + vb), 0) * weight * y
        nw = v - rate * (np.float32(1e-3) * v - 2 * (short if few else short @ x))
        nb = vb + rate * 2 * short.sum()
        move = np.float32((t - 1) / (t + 2))
        v, vb = nw + move * (nw - w), nb + move * (nb - b)
        w, b = nw, nb
    return np.append(w @ x if few else w, b)


class Sample:
    """Rows of features by their nonzero entries, and each row's language."""

    def __init__(self, sample: list[tuple[str, bytes]]):
        self.rows: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in sample:
            middle = text[len(text) // 2 :][:160]
            for part in (text, middle):
                x = features(part)
                at = np.flatnonzero(x)
                self.rows.setdefault(lang, []).append((at.astype(np.uint16), x[at]))

    def dense(self, langs: list[str], most: int) -> np.ndarray:
        """The first rows of these languages, as many of each."""
        own = [r for lang in langs for r in self.rows[lang][: max(1, most // len(langs))]]
        out = np.zeros((len(own), BUCKETS), dtype=np.float32)
        for i, (at, value) in enumerate(own):
            out[i, at] = value
        return out


class Votes:
    """One-versus-one machines between classes, each of one or more languages."""

    def __init__(self, classes: list[list[str]], sample: Sample):
        self.count = len(classes)
        self.pairs = list(combinations(range(self.count), 2))
        self.weights = np.zeros((BUCKETS + 1, len(self.pairs)), dtype=np.float32)
        if self.pairs:
            side = [sample.dense(langs, SIDE) for langs in classes]
            for k, (i, j) in enumerate(self.pairs):
                self.weights[:, k] = machine(np.vstack([side[i], side[j]]), np.repeat([1.0, -1.0], [len(side[i]), len(side[j])]))

    def __call__(self, x: np.ndarray) -> tuple[int, float]:
        """The class that wins, and its least probability against any other."""
        if not self.pairs:
            return 0, 1.0
        m = (x @ self.weights[:-1] + self.weights[-1]).astype(float)
        won, sums = np.zeros(self.count), np.zeros(self.count)
        for k, (i, j) in enumerate(self.pairs):
            won[i if m[k] >= 0 else j] += 1
            sums[i] += m[k]
            sums[j] -= m[k]
        best = max(range(self.count), key=lambda c: (won[c], sums[c]))
        least = min(m[k] if i == best else -m[k] for k, (i, j) in enumerate(self.pairs) if best in (i, j))
        return best, float(1 / (1 + np.exp(-4 * np.clip(least, -10, 10))))


def grouped(families: list[list[str]], means: np.ndarray, parts: int) -> list[list[int]]:
    """The families by number in `parts` groups of similar mean features: cut in halves along their
    first principal direction, again and again."""
    groups = [np.arange(len(families))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            x = means[g] - means[g].mean(axis=0)
            values, vectors = np.linalg.eigh(x @ x.T)
            order = g[np.argsort(vectors[:, -1] * np.sqrt(max(values[-1], 0)), kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    return [sorted(g.tolist()) for g in groups if len(g)]


class Step:
    """Votes between classes and, below each class, the next step or a language."""

    def __init__(self, families: list[list[str]], sample: Sample, means: dict[str, np.ndarray]):
        if len(families) == 1:
            classes, self.below = [[lang] for lang in families[0]], list(families[0])
        elif len(families) <= MOST:
            classes, self.below = families, [Step([f], sample, means) for f in families]
        else:
            mean = np.array([np.mean([means[lang] for lang in f], axis=0) for f in families])
            parts = [[families[i] for i in g] for g in grouped(families, mean, GROUPS)]
            classes, self.below = [[lang for f in part for lang in f] for part in parts], [Step(part, sample, means) for part in parts]
        self.votes = Votes(classes, sample)

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        best, p = self.votes(x)
        below = self.below[best]
        if isinstance(below, str):
            return below, p
        lang, q = below(x)
        return lang, p * q


class Model:
    def __init__(self, sample: list[tuple[str, bytes]]):
        self.first = None
        if not sample:
            return
        rows = Sample(sample)
        families: dict[str, list[str]] = {}
        for lang in sorted(rows.rows):
            families.setdefault(FAMILIES.get(lang, f"={lang}"), []).append(lang)
        means = {lang: rows.dense([lang], SIDE).mean(axis=0) for lang in rows.rows} if len(families) > MOST else {}
        self.first = Step([families[f] for f in sorted(families)], rows, means)

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        if self.first is None or not has_letter(text):
            return "und", 0.0
        return self.first(features(text))


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES, total: int = TOTAL, least: int = LEAST, total_bytes: int = TOTAL_BYTES) -> list[tuple[str, bytes]]:
    """Language and text of the bounded sample; `learn` is a condition on doc_id."""
    rows = docs.select("doc_id", "lang", "text").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).orderBy("lang").collect()}
    per_language = min(per_language, max(least, -(-total // max(len(known), 1))))
    language_bytes = min(language_bytes, total_bytes // max(len(known), 1))
    if not known:
        return []
    spark = docs.sparkSession
    # of each language the rows of least hash, by a share that leaves twice as many as are wanted
    share = spark.createDataFrame([(lang, min(1.0, (2 * per_language + 50) / n)) for lang, n in known.items()], "_lang string, _share double")
    low = F.pmod(F.col("o"), F.lit(1 << 53)) <= F.col("_share") * F.lit(float(1 << 53))
    keyed = rows.select("lang", "text", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("o"))
    near = keyed.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(low)
    sized = near.groupBy("lang", "o").agg(F.min("n").alias("n")).collect()  # repeated rows count once
    chosen, taken = [], dict.fromkeys(known, (0, 0))
    for r in sorted(sized, key=lambda r: (r["lang"], r["o"] % (1 << 53), r["o"])):
        k, size = taken[r["lang"]]
        if k < per_language and size + r["n"] <= language_bytes:
            taken[r["lang"]] = k + 1, size + r["n"]
            chosen.append((r["lang"], r["o"]))
    if not chosen:
        return []
    picked = spark.createDataFrame(chosen, "_lang string, _o long")
    joined = near.join(F.broadcast(picked.withColumnRenamed("_lang", "_of")), (F.col("lang") == F.col("_of")) & (F.col("o") == F.col("_o")))
    found = joined.groupBy("lang", "o").agg(F.min(F.col("text").cast("binary")).alias("text")).collect()
    found = sorted((r["o"], r["lang"], bytes(r["text"])) for r in found)
    return [(lang, text) for _, lang, text in found if has_letter(text)]


def identify(docs: DataFrame, held_out: Column, carry: tuple[str, ...] = ("doc_id", "held_out"), **bounds) -> DataFrame:
    """A row for each document: the columns `carry` and lang_pred, score. held_out is a condition
    on doc_id, and a column that can be carried; documents for which it is true are not learned
    from."""
    fitted = Model(sample(docs, ~F.coalesce(held_out, F.lit(True)), **bounds))
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))) if "held_out" in carry else docs
    return by_text(rows, list(carry), "lang_pred string, score double", lambda: lambda batch: columns_of([model.value(t) for t in batch], 2))
