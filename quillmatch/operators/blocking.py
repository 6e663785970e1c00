"""Blocking: candidate pairs of references that share rare tokens.

In single mode two references are a pair if they share a blocking token, in pair mode if they share
two. No list of token pairs is built: a join on the token gives, for each pair of references, how
often they agree, and pair mode asks for two agreements. A blocking token has at most beta
occurrences, so no key of that join is hot; the most frequent tokens are dropped before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import is_digit
from quillmatch.operators.stats import token_rows, without_heaviest
from quillmatch.plans.params import Params


def blocking_tokens(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """refID, token, m: the rare tokens of each reference and how often it has them."""
    return _rare_rows(refs, freq, p).groupBy("refID", "token").agg(F.count("*").alias("m"))


def _rare_rows(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """refID, pos, token: the occurrences of blocking tokens."""
    token = F.col("token")
    rare = freq.where(F.col("n").between(2, p.beta) & (F.char_length(token) >= p.minBlkTokenLen))
    if p.excludeNumericBlocks:
        rare = rare.where(~is_digit(token))
    return without_heaviest(token_rows(refs), freq, p.beta + 1).join(rare.select("token"), "token").select("refID", "pos", "token")


def _spelt_out_pairs(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """Candidate pairs by keys of two tokens written together, so that different tokens can make one
    key. A reference of k blocking tokens has k * (k - 1) / 2 of them."""
    rows = _rare_rows(refs, freq, p)
    a, b = rows.select("refID", F.col("pos").alias("p1"), F.col("token").alias("t1")), rows.select("refID", F.col("pos").alias("p2"), F.col("token").alias("t2"))
    keys = a.join(b, "refID").where("p1 < p2").groupBy("refID", F.concat(F.least("t1", "t2"), F.greatest("t1", "t2")).alias("key")).agg(F.count("*").alias("m"))
    one, two = keys.select(F.col("refID").alias("refID1"), "key"), keys.select(F.col("refID").alias("refID2"), "key")
    cross = one.join(two, "key").where("refID1 < refID2").select("refID1", "refID2").distinct()
    return cross.unionByName(keys.where("m > 1").select(F.col("refID").alias("refID1"), F.col("refID").alias("refID2")).distinct())


def candidate_pairs(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """refID1, refID2: distinct, refID1 <= refID2. A reference that repeats blocking tokens enough
    to share a key with itself pairs with itself. `refs` are those not resolved yet; `freq` counts
    all."""
    if p.blockByPairs and p.strictBlockKeys:
        return _spelt_out_pairs(refs, freq, p)
    bt = blocking_tokens(refs, freq, p)
    a, b = bt.select(F.col("refID").alias("refID1"), "token", F.col("m").alias("m1")), bt.select(F.col("refID").alias("refID2"), "token", F.col("m").alias("m2"))
    joined = a.join(b, "token").where("refID1 < refID2")
    if p.blockByPairs:
        cross = joined.groupBy("refID1", "refID2").agg(F.sum(F.least("m1", "m2")).alias("s")).where("s >= 2").drop("s")
        again = (F.max("m") >= 3) | ((F.max("m") >= 2) & (F.count("*") >= 2))
    else:
        cross = joined.select("refID1", "refID2").distinct()
        again = F.max("m") >= 2
    own = bt.groupBy("refID").agg(again.alias("again")).where("again").select(F.col("refID").alias("refID1"), F.col("refID").alias("refID2"))
    return cross.unionByName(own)


def block_sizes(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """token, refs: references in the block of each blocking token, for blocks of more than one."""
    return blocking_tokens(refs, freq, p).groupBy("token").agg(F.count("*").alias("refs")).where("refs > 1")


def comparison_tokens(refs: DataFrame, freq: DataFrame, p: Params) -> DataFrame:
    """refID, tokens: what is left to compare, in order. Tokens of frequency sigma or more are
    dropped; so are short and excluded numeric ones, and repeats, where the parameters say so. A
    token that freq doesn't hold has frequency 0."""
    token = F.col("token")
    drop = F.coalesce(F.col("n"), F.lit(0)) >= p.sigma
    if p.removeExcludedBlkTokens:
        drop = drop | (F.char_length(token) < p.minBlkTokenLen)
        if p.excludeNumericBlocks:
            drop = drop | is_digit(token)
    rows = without_heaviest(token_rows(refs), freq, p.sigma)
    # of the frequencies only those that drop a token are joined, which are few of all
    rows = rows.join(freq.where(F.col("n") >= p.sigma).select("token", "n"), "token", "left").where(~drop)
    kept = rows.groupBy("refID").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    kept = kept.select(F.col("refID").alias("_id"), F.transform("t", lambda x: x["token"]).alias("t"))
    tokens = F.coalesce(F.col("t"), F.array().cast("array<string>"))
    if p.removeDuplicateTokens:
        tokens = F.array_distinct(tokens)
    return refs.select("refID").join(kept, F.col("refID") == F.col("_id"), "left").select("refID", tokens.alias("tokens"))
