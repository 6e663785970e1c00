"""Substring dedup by sliding sentence spans.

A text's sentences end after ".", "!", "?" (a closing quote or bracket may follow) before ASCII
white space, after their full-width forms, and at line breaks; one of more than `sentence_words`
words is cut before each word whose hash is the least of the five around it, so that the cuts of a
shared passage don't depend on what stands before it; where words repeat so that there is no such
word, after each `sentence_words` words. A span is a run of at least `sentences` consecutive
sentences that have `span_words` words together, no longer than needed: from each sentence on the
shortest such run that begins there, and the shortest that ends there. Together these cover every
repeated passage of so many sentences and words from its first sentence to its last. A span is
hashed by its words alone (A-Z lower-cased, without punctuation and spacing), sentence by sentence.

Each document sends a hash of each of its spans once: this table is written and read twice. A global
aggregate finds the hashes that several documents have, and the first of them by doc_id; all others
remove the sentences that the span covers. A span that a document repeats is kept at its first place
there and its other places are removed. Texts that lose something are parted anew, all others are
passed on. What stays of a text stays as it was.

With the settings here a passage of over 50 words of whole sentences is found, and inside of long
sentences one that has three cuts or more between words which have it two words on both sides; a cut
is at every fifth word on average.

Defined results: a null text stays null and has no sentences; an empty one has none; rows of equal
doc_id are one document at the same place, so that they don't remove each other's spans; a null
doc_id comes before all others; other columns, whatever their names, are passed on as they are (one
that is named as one of the results is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.staging import release, staged, unstage

from .common import INVERSE, arrow_schema, bounded_batches, id_type, mix, powers, prefix_sums, run_hashes, slices, texts, trimmed

SENTENCES = 3
SPAN_WORDS = 20
SENTENCE_WORDS = 16
#: Words on both sides that a cut in a long sentence looks at.
REACH = 2

_KEY = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Kinds of bytes: white space, line breaks, stops, what may close after a stop, parts of words.
_SPACE, _BREAK, _STOP, _CLOSE, _WORD = 1, 2, 4, 8, 16
_KIND = np.array([_SPACE * (b in b"\t\n\v\f\r ") | _BREAK * (b == 10) | _STOP * (b in b".!?") | _CLOSE * (b in b"\"')]") | _WORD * (_KEY[b] != 32) for b in range(256)], dtype=np.uint8)
#: The full-width stops.
_WIDE = tuple(c.encode() for c in "。！？")


def _starts(flags: np.ndarray) -> np.ndarray:
    """Where runs of true begin; the first is false."""
    return np.flatnonzero(flags[1:] & ~flags[:-1]) + 1


class Parted:
    """The sentences of several texts, found in one go over all their bytes. A sentence is a place
    in `begin` (its first byte; `raw` holds the texts, parted by zero bytes); `first` has the
    first sentence of each text, and the end of the last; `words` the words before each sentence."""

    def __init__(self, batch: list[bytes | None], longest: int = SENTENCE_WORDS):
        self.raw = b"\0\0" + b"\0".join([t or b"" for t in batch]) + b"\0"
        size = np.array([len(t or b"") for t in batch], dtype=np.int64)
        self.at = np.cumsum(size + 1) - size + 1  # of each text
        full = self.at[size > 0]
        raw = np.frombuffer(self.raw, dtype=np.uint8)
        kind = _KIND[raw]
        space = kind & _SPACE > 0
        runs, ends = _starts(space), _starts(~space)  # as many: zero bytes stand around
        over = (kind[runs - 1] & _STOP) | ((kind[runs - 1] & _CLOSE) > 0) * (kind[runs - 2] & _STOP)
        over = over > 0
        over[np.searchsorted(runs, np.flatnonzero(kind & _BREAK), side="right") - 1] = True
        begin = [full, ends[over]]
        for wide in _WIDE:
            at = self.raw.find(wide)
            while at >= 0:
                begin.append(np.array([at + len(wide)]))
                at = self.raw.find(wide, at + 1)
        begin = np.setdiff1d(np.concatenate(begin), self.at + size)  # none at a text's end
        word = _starts(kind & _WORD > 0)
        self.word_hash = run_hashes(np.frombuffer(self.raw.translate(_KEY), dtype=np.uint8), word, _starts(kind & _WORD == 0))
        cuts = self._cuts(begin, word, np.unique(np.concatenate([ends, full])), longest)
        self.begin = np.unique(np.concatenate([begin, cuts])) if len(cuts) else begin
        self.end = np.append(self.begin, 0)[1:]
        self.words = np.append(np.searchsorted(word, self.begin), len(word))
        self.first = np.append(np.searchsorted(self.begin, self.at), len(self.begin))
        self.end[self.first[1:][size > 0] - 1] = (self.at + size)[size > 0]

    def _cuts(self, begin: np.ndarray, word: np.ndarray, tokens: np.ndarray, longest: int) -> np.ndarray:
        """Where long sentences are cut: before the first word of a run without white space."""
        token = np.searchsorted(tokens, word, side="right")
        lead = np.ones(len(word), dtype=bool)
        lead[1:] = token[1:] != token[:-1]
        of = np.searchsorted(begin, word[lead], side="right")
        long = np.bincount(of, minlength=len(begin) + 1) > longest
        keep = long[of]
        if not keep.any():
            return np.zeros(0, dtype=np.int64)
        of, h, token = of[keep], self.word_hash[lead][keep], token[lead][keep]
        n = len(of)
        new = np.ones(n, dtype=bool)
        new[1:] = of[1:] != of[:-1]
        low = ~new
        for by in range(1, REACH + 1):
            same = of[by:] == of[:-by]
            low[by:] &= ~same | (h[by:] < h[:-by])
            low[: n - by] &= ~same | (h[: n - by] <= h[by:])
        i = np.arange(n)
        since = i - np.maximum.accumulate(np.where(low | new, i, 0))
        return tokens[token[low | ((since > 0) & (since % longest == 0))] - 1]

    def spans(self, least: int = SENTENCES, words: int = SPAN_WORDS) -> tuple[np.ndarray, ...]:
        """Text, first sentence, end and hash of each span, by place."""
        n = len(self.begin)
        total = self.words
        of = np.repeat(np.arange(len(self.at)), np.diff(self.first))
        i = np.arange(n)
        to = np.maximum(i + least, np.searchsorted(total, total[:-1] + words))
        since = np.minimum(i + 1 - least, np.searchsorted(total, total[1:] - words, side="right") - 1)
        ahead, behind = to <= self.first[1:][of], since >= self.first[:-1][of]
        a, b = np.concatenate([i[ahead], since[behind]]), np.concatenate([to[ahead], i[behind] + 1])
        key = np.unique(a * (n + 1) + b)
        a, b = key // (n + 1), key % (n + 1)
        sums = prefix_sums(self.word_hash)
        size = np.diff(total)
        sentence = mix((sums[total[1:]] - sums[total[:-1]]) * powers(len(self.word_hash), INVERSE)[total[:-1]] + size.astype(np.uint64))
        sums = prefix_sums(sentence)
        value = (sums[b] - sums[a]) * powers(n, INVERSE)[a]
        return of[a], a, b, mix(value + (b - a).astype(np.uint64))


def sentences(text: str, longest: int = SENTENCE_WORDS) -> list[str]:
    """The sentences with what parts them; joined, they are the text."""
    p = Parted([text.encode()], longest)
    return [p.raw[a:b].decode() for a, b in zip(p.begin.tolist(), p.end.tolist(), strict=True)]


def span_hashes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, h: each span hash of a row once; and a row for each row, without h, that has the
    number of its sentences and whether one of its spans repeats in it."""
    ddl = f"doc_id {id_type(docs, 'doc_id')}, h long, n int, again boolean"
    schema = arrow_schema(ddl)
    longest, least, words = _settings(settings)

    def run(it):
        for batch in slices(trimmed(it)):
            p = Parted(texts(batch), longest)
            of, _, _, h = p.spans(least, words)
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            k = np.bincount(of[~first], minlength=len(p.at))
            of, h = of[first], h[first].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(len(p.at), pa.int64()), pa.array(np.diff(p.first).astype(np.int32)), pa.array(k > 0)], schema=schema)
            for i in range(0, len(h), 100_000):
                part = h[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[i : i + 100_000])), pa.array(part), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.bool_())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _settings(given: dict) -> tuple[int, int, int]:
    known = {"sentence_words": SENTENCE_WORDS, "sentences": SENTENCES, "span_words": SPAN_WORDS} | given
    return known["sentence_words"], known["sentences"], known["span_words"]


_RESULT = "n_sentences long, n_removed long, n_words_removed long"


def dedup_spans(docs: DataFrame, **settings) -> DataFrame:
    """The documents with the repeated spans taken out of `text`, and n_sentences, n_removed
    (sentences), n_words_removed. Settings: sentences, span_words, sentence_words."""
    longest, least, words = _settings(settings)
    bounded_batches(docs.sparkSession)
    hashes = staged(span_hashes(docs, **settings))
    spans = hashes.where("h IS NOT NULL").select("doc_id", "h")
    # a null doc_id is before all others
    repeated = spans.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    repeated = repeated.where("first < last OR (unnamed AND first IS NOT NULL)").select(F.col("h").alias("_h"), "first", "unnamed")
    later = spans.where("doc_id IS NOT NULL").join(repeated, (F.col("h") == F.col("_h")) & (F.col("unnamed") | (F.col("doc_id") > F.col("first"))))
    none = F.lit(None)
    parts = later.select("doc_id", "h", none.cast("int").alias("n"), none.cast("boolean").alias("again")).unionByName(hashes.where("h IS NULL"))
    gone = parts.groupBy("doc_id").agg(F.collect_set("h").alias("gone"), F.max("n").alias("n"), (F.max("again") | (F.min("n") < F.max("n"))).alias("again"))
    # written before the texts are dealt out, so that both don't need room at once
    gone = staged(gone.withColumnRenamed("doc_id", "gone_id"))
    unstage(hashes)
    release(docs.sparkSession)

    added = arrow_schema(_RESULT)
    own = [c for c in docs.columns if c not in added.names]
    # named by number, so that no column of the caller's can clash
    left = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    text_at = own.index("text")
    rows = left.join(gone, left[f"c{own.index('doc_id')}"].eqNullSafe(gone["gone_id"]), "left").select(*left.columns, "gone", "n", "again")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in own), _RESULT])
    schema = arrow_schema(ddl)

    def run(it):
        for batch in slices(trimmed(it), column=text_at):
            columns = list(batch.columns[: len(own)])
            removals, n, again = (c.to_pylist() for c in batch.columns[len(own) :])
            counts = np.zeros((len(added), batch.num_rows), dtype=np.int64)
            counts[0] = n
            # only texts that lose something, or may, are parted again
            some = [i for i, g in enumerate(removals) if g or again[i]]
            if some:
                found = texts(batch, f"c{text_at}")
                p = Parted([found[i] for i in some], longest)
                counts[0, some] = np.diff(p.first)
                drop = covered(p, [removals[i] for i in some], least, words)
                for k, i in enumerate(some):
                    found[i], *counts[1:, i] = without(found[i], p, k, drop)
                columns[text_at] = pa.array(found, type=pa.binary()).cast(schema.field(text_at).type)
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, list(schema)[: len(own)], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts)], schema=schema)

    return rows.mapInArrow(run, ddl)


def covered(p: Parted, gone: list[list[int]], least: int = SENTENCES, words: int = SPAN_WORDS) -> np.ndarray:
    """Which sentences a span covers that an earlier document has, or an earlier place of the text."""
    of, a, b, h = p.spans(least, words)
    order = np.lexsort((h, of))  # stable: within a text and hash by place
    hit = np.zeros(len(h), dtype=bool)
    hit[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    at = np.searchsorted(of, np.arange(len(gone) + 1)).tolist()
    for k, g in enumerate(gone):
        if g:
            hit[at[k] : at[k + 1]] |= np.isin(h[at[k] : at[k + 1]], np.array(g, dtype=np.int64).view(np.uint64))
    n = len(p.begin) + 1
    return np.cumsum(np.bincount(a[hit], minlength=n) - np.bincount(b[hit], minlength=n))[:-1] > 0


def without(text: bytes | None, p: Parted, k: int, drop: np.ndarray) -> tuple[bytes | None, int, int]:
    """The k-th of the parted texts without the sentences to drop, and how many sentences and words
    (parted by white space) those were."""
    i, j = p.first[k : k + 2].tolist()
    gone = drop[i:j]
    if not gone.any():
        return text, 0, 0
    places = list(zip(p.begin[i:j].tolist(), p.end[i:j].tolist(), gone.tolist(), strict=True))
    return b"".join([p.raw[x:y] for x, y, g in places if not g]), int(gone.sum()), sum(len(p.raw[x:y].split()) for x, y, g in places if g)
