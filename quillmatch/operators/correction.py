"""Global token correction: rare tokens that are one edit from a frequent one are replaced by it.

Standard and error tokens meet on what they become by losing one character, long ones on a third of
their letters that one edit leaves alone, so no pair is compared that isn't nearly equal; the
distance then confirms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.similarity import edit_keys, swapped
from quillmatch.functions.text import is_alpha
from quillmatch.operators.stats import token_rows
from quillmatch.plans.params import Params
from quillmatch.plans.staging import staged

#: Of the tokens by rank, this many are never corrected.
UNTOUCHED = 2
#: A table of corrections of at most so many rows and bytes of text is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16_000_000


def clean_tokens(freq: DataFrame, words: DataFrame | None, p: Params) -> DataFrame:
    """token, n, first of the tokens that can be a standard or an error: letters only, long enough,
    and no rare word of the word list."""
    rows = freq.where((F.char_length("token") >= p.minLenStdToken) & is_alpha(F.col("token")))
    if words is None:
        return rows
    listed = words.select(F.col("word").alias("_w"), F.lit(True).alias("_listed")).distinct()
    rows = rows.join(listed, F.col("token") == F.col("_w"), "left")
    return rows.where(~((F.col("n") <= p.maxFreqErrToken) & F.coalesce("_listed", F.lit(False)))).select("token", "n", "first")


def corrections(freq: DataFrame, p: Params, words: DataFrame | None = None) -> DataFrame:
    """bad, std: for each error token the standard of highest rank that is one edit away. Rank is
    by frequency, then by first occurrence; the last of all is no standard, the first two no error.
    """
    clean = staged(clean_tokens(freq, words, p))  # it is read four times
    rank = [F.desc("n"), F.asc("first")]
    first = clean.orderBy(*rank).limit(UNTOUCHED).select(F.col("token").alias("_x"))
    last = clean.orderBy(F.asc("n"), F.desc("first")).limit(1).select(F.col("token").alias("_x"))
    std = clean.where(F.col("n") >= p.minFreqStdToken).join(F.broadcast(last), F.col("token") == F.col("_x"), "left_anti")
    err = clean.where(F.col("n") <= p.maxFreqErrToken).join(F.broadcast(first), F.col("token") == F.col("_x"), "left_anti")
    std = std.select(F.col("token").alias("std"), F.struct((-F.col("n")).alias("n"), "first").alias("rank"), F.explode(edit_keys(F.lower("token"), probe=True)).alias("key"))
    err = err.select(F.col("token").alias("bad"), F.explode(edit_keys(F.lower("token"), probe=False)).alias("key"))
    a, b = F.lower("std"), F.lower("bad")
    distance = F.levenshtein(a, b, 2)
    near = (distance == 1) | ((distance == 2) & swapped(F.col("std"), F.col("bad")))
    # a staged table's size is that of its compressed files, before tokens become keys: by that size
    # hundreds of MB of keys would be broadcast
    return std.join(err.hint("merge"), "key").where(near).groupBy("bad").agg(F.min_by("std", "rank").alias("std"))


def with_variants(found: DataFrame, variants: DataFrame) -> DataFrame:
    """bad, std where known variants (std, variant) override what was found."""
    known = variants.groupBy("variant").agg(F.max("std").alias("known"))
    joined = found.join(known, F.col("bad") == F.col("variant"), "full_outer")
    return joined.select(F.coalesce("bad", "variant").alias("bad"), F.coalesce("known", "std").alias("std"))


def learned_variants(variants: DataFrame, found: DataFrame) -> DataFrame:
    """std, variants (sorted): the known ones and those found (bad, std) that are letters only, not
    known under any standard, and no standard's own name."""
    old = variants.select("std", "variant").distinct()
    known = old.select(F.col("variant").alias("_v")).distinct()
    fresh = found.where(is_alpha(F.col("bad")) & is_alpha(F.col("std")) & (F.col("bad") != F.col("std"))).select("std", F.col("bad").alias("variant"))
    fresh = fresh.join(known, F.col("variant") == F.col("_v"), "left_anti")
    return old.unionByName(fresh).groupBy("std").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def replaced(freq: DataFrame, found: DataFrame) -> DataFrame:
    """old, new, n: how many occurrences of each token give way to its correction."""
    return found.join(freq.select("token", "n"), F.col("bad") == F.col("token")).select(F.col("bad").alias("old"), F.col("std").alias("new"), "n")


def apply_corrections(refs: DataFrame, found: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """refs (refID, tokens, ord) with each token replaced once, and n_changed. Corrections of at most
    `rows` rows and `size` bytes go to the tokens; beyond that, tokens and corrections are joined by
    a shuffle, in which adaptive execution splits a frequent token. They are dealt out before it, so
    that they count by their bytes there, not by those of the compressed files they come from."""
    fix = staged(found.select(F.col("bad").alias("_bad"), F.col("std").alias("_std")))
    total = fix.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_bad") + F.octet_length("_std")), F.lit(0)).alias("size")).first()
    few = total["n"] <= rows and total["size"] <= size
    fix = F.broadcast(fix) if few else fix.repartition(fix.sparkSession.sparkContext.defaultParallelism)
    new = token_rows(refs).join(fix, F.col("token") == F.col("_bad"), "left").groupBy("refID").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_std", "token").alias("token")))).alias("_t"), F.count("_std").alias("_n"))
    new = new.select(F.col("refID").alias("_id"), F.transform("_t", lambda x: x["token"]).alias("_t"), "_n")
    joined = refs.join(new, F.col("refID") == F.col("_id"), "left")
    return joined.select("refID", F.coalesce("_t", "tokens").alias("tokens"), "ord", F.coalesce("_n", F.lit(0)).alias("n_changed"))
