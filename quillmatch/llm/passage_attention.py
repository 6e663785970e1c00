"""Quality of documents by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of about `PASSAGE` bytes; it has a label, its passages have none.
Each passage is encoded: hashed byte bigrams and trigrams (case kept, digits alike), square-rooted
and scaled to length one, and some statistics of its bytes go through a layer of `WIDTH` tanh units.
Gated attention, softmax over the bag of w'(tanh(hV) * sigmoid(hU)), weighs the passages, and a
logistic unit scores the weighted sum of their encodings. All weights are learned together from
document labels (Adam on the cross-entropy, classes weighing alike); a fifth of the sample is kept
out of that, and the score is calibrated on it by its own class frequencies.

The classifier is fitted on the bounded sample that `toxicity.sample` draws: per class `per_class`
documents and `class_bytes` bytes of text at most. Every whole text is scored, whatever its length:
encodings are made piece by piece, and attention runs over all of them.

Defined results: a null text, or one of white space alone, has no passage and gets the share of
label 1 among the sample, at most 0.5; rows whose label is null or neither 0 nor 1 are not learned
from; of several labels of a document the greatest holds; without labels of both classes every score
is 0; equal texts get equal scores, repeated rows one each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text
from .toxicity import logistic, sample

PASSAGE = 384
#: Passages that are encoded at once.
PIECE = 1024
BUCKETS = 1 << 10
WIDTH, GATE = 16, 8
PER_CLASS = 2000
CLASS_BYTES = 4_000_000
EPOCHS, BAGS, RATE, DECAY = 12, 32, 0.01, 1e-4
THRESHOLD = 0.7

#: Digits count as one, all other bytes as they are.
_BYTES = bytes(48 if 48 <= b <= 57 else b for b in range(256))
#: Kinds of bytes: upper and lower case, digits, white space, non-ASCII, all others.
_KIND = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\v\f\r" else 4 if b >= 128 else 5 for b in range(256)])
KINDS = 6
STATISTICS = KINDS + 4


def blank(text: bytes | None) -> bool:
    return not text or text.isspace()


def pieces(text: bytes) -> list[bytes]:
    """A text in runs of PIECE passages."""
    size = PASSAGE * PIECE
    return [text[i : i + size] for i in range(0, len(text), size)]


def counted(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of hashed n-grams and statistics of all passages, and how many each piece has."""
    size = np.array([len(t) for t in batch], dtype=np.int64)
    many = np.maximum((size + PASSAGE // 2) // PASSAGE, 1)
    raw = np.frombuffer((b"\n\n" + b"\n\n".join(batch)).translate(_BYTES), dtype=np.uint8)
    start = np.cumsum(size + 2) - size  # of each piece's text
    inside = np.ones(len(raw), dtype=bool)
    inside[start - 1] = inside[start - 2] = False
    at = np.flatnonzero(inside)
    local = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    passage = np.minimum(local // PASSAGE, np.repeat(many - 1, size)) + np.repeat(np.cumsum(many) - many, size)
    total = int(many.sum())
    a, b, c = (raw[at - k].astype(np.uint32) for k in (0, 1, 2))
    two = ((b * np.uint32(257) + a) * np.uint32(0x9E3779B1)) >> np.uint32(22)
    three = ((c * np.uint32(66049) + b * np.uint32(257) + a + np.uint32(7)) * np.uint32(0x85EBCA77)) >> np.uint32(22)
    counts = np.empty((total, 2 * BUCKETS), dtype=np.uint8)
    for k, x in enumerate((two, three)):
        found = np.bincount(passage * BUCKETS + x, minlength=total * BUCKETS).reshape(total, BUCKETS)
        counts[:, k * BUCKETS : (k + 1) * BUCKETS] = np.minimum(found, 255)
    kinds = np.bincount(passage * KINDS + _KIND[a], minlength=total * KINDS).reshape(total, KINDS)
    length = np.maximum(kinds.sum(axis=1), 1)
    other = [np.log1p(length), (counts[:, :BUCKETS] > 0).sum(axis=1) / length, (counts[:, BUCKETS:] > 0).sum(axis=1) / length, counts[:, BUCKETS:].max(axis=1) / length]
    return counts, np.column_stack([kinds / length[:, None], *other]).astype(np.float32), many


def _vectors(counts: np.ndarray, statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-6)[:, None]
    return np.hstack([x, (statistics - mean) / scale * np.float32(0.3)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The weights, and forward and backward passes over bags of passages."""

    def __init__(self, inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = {
            "encode": rng.normal(0, 0.3, (inputs, WIDTH)), "shift": np.zeros(WIDTH), "tanh": rng.normal(0, 0.3, (WIDTH, GATE)), "gate": rng.normal(0, 0.3, (WIDTH, GATE)),
            "attend": rng.normal(0, 0.3, GATE), "score": rng.normal(0, 0.3, WIDTH), "bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["encode"] + self.w["shift"])

    def attention(self, h: np.ndarray, first: np.ndarray, size: np.ndarray):
        """The weight of each passage in its bag, bags being runs of passages, and the gate's halves."""
        t, g = np.tanh(h @ self.w["tanh"]), _sigmoid(h @ self.w["gate"])
        a = (t * g) @ self.w["attend"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), size))
        return a / np.repeat(np.add.reduceat(a, first), size), t, g

    def logits(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = np.cumsum(size) - size
        a, _, _ = self.attention(h, first, size)
        return np.add.reduceat(a[:, None] * h, first) @ self.w["score"] + self.w["bias"]

    def gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of bags x (runs of `size` passages) with labels y."""
        w, first = self.w, np.cumsum(size) - size
        h = self.encode(x)
        a, t, g = self.attention(h, first, size)
        z = np.add.reduceat(a[:, None] * h, first)
        error = ((_sigmoid(z @ w["score"] + w["bias"]) - y) * weight).astype(np.float32)
        each = np.repeat(error, size)
        reach = h @ w["score"]  # what each passage alone would score
        dh = (each * a)[:, None] * w["score"]
        da = each * reach
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        inner = ds[:, None] * w["attend"]
        dt, dg = inner * g * (1 - t * t), inner * t * g * (1 - g)
        dh += dt @ w["tanh"].T + dg @ w["gate"].T
        du = dh * (1 - h * h)
        return {"encode": x.T @ du, "shift": du.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ ds, "score": z.T @ error, "bias": error.sum(keepdims=True)}


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.steps = w, rate, 0
        self.one, self.two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def __call__(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, g in gradient.items():
            self.one[k] += 0.1 * (g - self.one[k])
            self.two[k] += 0.001 * (g * g - self.two[k])
            step = (self.one[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.two[k] / (1 - 0.999**self.steps)) + 1e-8)
            self.w[k] -= (rate * (step + DECAY * self.w[k])).astype(np.float32)


class Model:
    def __init__(self, found: list[tuple[bytes | None, int]]):
        """found: texts and labels, in an order that has nothing to do with either."""
        self.net = None
        bags = [(t, y) for t, y in found if not blank(t)]
        y = np.array([y for _, y in bags], dtype=np.float32)
        if len(set(y.tolist())) < 2:
            return
        self.prior = min(0.5, float(y.mean()))
        made = [counted(pieces(t)) for t, _ in bags]
        statistics = np.vstack([s for _, s, _ in made])
        self.mean, self.scale = statistics.mean(axis=0), statistics.std(axis=0) + np.float32(1e-3)
        size = np.array([len(s) for _, s, _ in made])
        self.net = Attention(2 * BUCKETS + STATISTICS)
        kept = self._kept_out(y)
        self._train(made, size, y, np.flatnonzero(~kept))
        held = np.flatnonzero(kept)
        logit = np.concatenate([self.net.logits(self._encoded(*made[i][:2]), size[i : i + 1]) for i in held]).astype(float)
        spread = max(float(logit.std()), 1e-6)
        self.slope, self.offset = logistic((logit / spread)[:, None], y[held].astype(float), ridge=1.0)
        self.slope = max(float(self.slope), 0.0) / spread

    @staticmethod
    def _kept_out(y: np.ndarray) -> np.ndarray:
        """Each fifth document of each class; of a class of fewer, all calibrate and teach."""
        out = np.zeros(len(y), dtype=bool)
        for c in (0, 1):
            own = np.flatnonzero(y == c)
            out[own[4::5] if len(own) >= 5 else own] = True
        return out

    def _encoded(self, counts: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return np.vstack([self.net.encode(_vectors(counts[i : i + PIECE], statistics[i : i + PIECE], self.mean, self.scale)) for i in range(0, len(counts), PIECE)])

    def _train(self, made, size, y, rows: np.ndarray) -> None:
        rng, adam = np.random.default_rng(7), Adam(self.net.w, RATE)
        if len(set(y[rows].tolist())) < 2:
            rows = np.arange(len(y))
        share = {c: max(float((y[rows] == c).mean()), 1e-6) for c in (0.0, 1.0)}
        for epoch in range(EPOCHS):
            order = rng.permutation(rows)
            for at in range(0, len(order), BAGS):
                own = order[at : at + BAGS]
                x = np.vstack([_vectors(*made[i][:2], self.mean, self.scale) for i in own])
                weight = np.array([0.5 / share[float(v)] for v in y[own]], dtype=np.float32) / len(own)
                adam(self.net.gradient(x, size[own], y[own], weight), RATE * (1 - epoch / EPOCHS))

    def __call__(self, batch: list[bytes | None]) -> list[float]:
        """The score of each text."""
        if self.net is None:
            return [0.0] * len(batch)
        out = np.full(len(batch), self.prior)
        parts, of = [], []
        for i, t in enumerate(batch):
            if not blank(t):
                parts += (own := pieces(t))
                of += [i] * len(own)
        if not parts:
            return out.tolist()
        size = np.bincount(of, weights=[max((len(p) + PASSAGE // 2) // PASSAGE, 1) for p in parts], minlength=len(batch)).astype(np.int64)
        hidden, held, many = [], [], 0
        for p in [*parts, None]:
            if held and (p is None or many + len(p) > PASSAGE * PIECE):
                hidden.append(self._encoded(*counted(held)[:2]))
                held, many = [], 0
            if p is not None:
                held.append(p)
                many += len(p) + 2 * PASSAGE // 3
        full = np.flatnonzero(size)
        out[full] = _sigmoid(self.slope * self.net.logits(np.vstack(hidden), size[full]) + self.offset)
        return out.tolist()


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", threshold: float = THRESHOLD, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted. held_out is a condition on
    doc_id; documents for which it is true are not learned from."""
    learned = sample(docs, labels, ~F.coalesce(held_out, F.lit(True)), per_class, class_bytes, label)
    model = docs.sparkSession.sparkContext.broadcast(Model(learned))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def judge(batch):
        found = model.value(batch)
        return [found, [int(p >= threshold) for p in found]]

    return by_text(rows, ["doc_id", "held_out"], "score double, predicted int", lambda: judge)
