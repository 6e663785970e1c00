"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A text's words are parted by white space and lower-cased; its shingles are runs of `words`
consecutive words, and a text of fewer, but not none, is one shingle as a whole. The sketch holds
the k smallest distinct 64-bit hashes of its shingles, as a sorted array. Sketches of parts merge
into the sketch of the whole: the k smallest of all they hold. Two sketches estimate

* resemblance: the share of the k smallest hashes of their union that both hold;
* distinct shingles: exact below k, else (k - 1) / the k-th smallest as a share of the hash range;
* containment of a in b: resemblance times the distinct shingles of the union over those of a.

Defined results: a null or empty text has an empty sketch; two empty sketches resemble each other
fully, an empty and another not at all; an empty sketch is contained in any. Equal texts have
equal sketches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 128
WORDS = 5
#: The range of signed 64-bit hashes.
_LEAST, _RANGE = float(-(1 << 63)), float(1 << 64)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of its column `text` as array<long>. Each step is a column of its own,
    so that it is computed once."""
    w, h, s = f"_{out}_w", f"_{out}_h", f"_{out}_s"
    df = df.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    n = F.size(h)
    runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.col(h)[i + j] for j in range(words))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(s, F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(h, n))).otherwise(none)).drop(h)
    return df.withColumn(out, _smallest(F.col(s), k)).drop(s)


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return _smallest(F.concat(a, b), k)


def merge(sketches: DataFrame, by: list[str], sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """The sketch of each group. A hot group is first merged in `salts` parts, by a hash of the
    sketch, each of which sends k hashes at most."""
    parts = sketches.where(F.col(sketch).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(sketch), F.lit(salts)))
    # the k smallest of a part, by rank among its distinct hashes
    each = parts.select(*by, "_salt", F.explode(sketch).alias("_h")).distinct()
    rank = W.partitionBy(*by, "_salt").orderBy("_h")
    low = each.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k)
    return low.groupBy(*by).agg(_smallest(F.collect_set("_h"), k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    share = (F.element_at(sketch, k).cast("double") - F.lit(_LEAST)) / F.lit(_RANGE)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_string(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _cuts(docs: DataFrame, n: int, buckets: int) -> list:
    """Up to buckets - 1 pairs (doc_id, hash of the text) that part the documents about evenly: from
    a sample by hash, eight times as many."""
    pairs = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tie"))
    few = pairs.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, n // (8 * buckets)))) == 0).distinct()
    found = few.orderBy("doc_id", "tie").collect()
    return [tuple(found[i * len(found) // buckets]) for i in range(1, buckets)] if len(found) >= buckets else []


def _pair(found: tuple, kind) -> Column:
    return F.struct(F.lit(found[0]).cast(kind).alias("doc_id"), F.lit(found[1]).cast("long").alias("_tie"))


def _bucket(cuts: list, row: Column, kind) -> Column:
    """How many of the ascending cuts are at most `row`: first among every so many, then between."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))

    def array(of: list) -> Column:
        return F.array(*(_pair(c, kind) for c in of))

    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    block = F.size(F.filter(array([b[0] for b in blocks]), lambda c: c <= row))
    inside = F.size(F.filter(F.element_at(F.array(*map(array, blocks)), F.greatest(block, F.lit(1))), lambda c: c <= row))
    return F.greatest(block - 1, F.lit(0)) * step + inside


def with_next(docs: DataFrame, rows_per_bucket: int = 2000) -> tuple[DataFrame, W]:
    """docs (doc_id, text) dealt out in buckets of consecutive rows by doc_id and a hash of the text,
    with `_extra` and a window in which each document is followed by the next by doc_id, and the
    last one by the first. A bucket ends with a copy (_extra is true) of the next bucket's first
    document, so no bucket needs another. Null doc_ids come last; rows of equal doc_id are ordered
    by a hash of the text. A bucket has about `rows_per_bucket` documents, or as many as there are
    buckets: both grow with the root of the table, and neither has a bound."""
    n = docs.count()
    buckets = max(1, -(-n // max(rows_per_bucket, int(n**0.5))))
    cuts = _cuts(docs, n, buckets) if buckets > 1 else []
    tie, kind = F.xxhash64("text").alias("_tie"), docs.schema["doc_id"].dataType
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_bucket(cuts, F.struct("doc_id", tie), kind))
    rows = docs.select("doc_id", "text", tie, at.alias("_bucket"))
    # a row for each bucket
    first = rows.where("doc_id IS NOT NULL").groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("head"))
    heads = sorted((r["_bucket"], r["head"]) for r in first.collect())
    last = len(cuts)
    copies = F.array(F.struct(F.col("_bucket"), F.lit(False).alias("_extra")))
    if heads:
        head_of, before = dict(heads), {b: heads[i - 1][0] if i else last for i, (b, _) in enumerate(heads)}
        own = F.element_at(F.array(*(_pair(head_of.get(b, (None, None)), kind) for b in range(last + 1))), F.col("_bucket") + 1)
        to = F.element_at(F.array(*(F.lit(before.get(b, last)) for b in range(last + 1))), F.col("_bucket") + 1)
        again = F.struct(to.alias("_bucket"), F.lit(True).alias("_extra"))
        copies = F.when(F.struct("doc_id", "_tie") == own, F.array(F.struct(F.col("_bucket"), F.lit(False).alias("_extra")), again)).otherwise(copies)
    rows = rows.select("doc_id", "text", "_tie", F.explode(copies).alias("_at")).select("doc_id", "text", "_tie", "_at._bucket", "_at._extra")
    return rows, W.partitionBy("_bucket").orderBy("_extra", F.asc_nulls_last("doc_id"), "_tie")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated). The edited text is the text with its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document."""
    rows, order = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(order), F.col("text")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("_next"), F.lit(1), half))
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = with_sketch(with_sketch(rows, "text", "_own", k, words).drop("text"), "_edited", "_new", k, words)
    rows = rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_own", "_new", "_bucket", "_extra", "_tie")
    rows = rows.withColumn("_after", F.coalesce(F.lead("_own").over(order), F.col("_own"))).where(~F.col("_extra"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("_own")).alias("fingerprint"),
        as_string(F.col("_new")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_new"), k).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_after"), k).alias("near_next"),
        distinct_shingles(F.col("_own"), k).alias("n_shingles"),
    )
