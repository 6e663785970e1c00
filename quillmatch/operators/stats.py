"""Tokens of references and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import is_digit, tokenizer
from quillmatch.plans.params import Params


def tokenize(refs: DataFrame, p: Params) -> DataFrame:
    """refID, tokens, ord of references with a body."""
    tokens = tokenizer(p.tokenizerType)(F.col("body"), p.delimiter)
    return refs.select("refID", (F.array_distinct(tokens) if p.removeDuplicateTokens else tokens).alias("tokens"), "ord")


def token_rows(refs: DataFrame) -> DataFrame:
    """refID, ord, pos, token."""
    return refs.select("refID", "ord", F.posexplode("tokens").alias("pos", "token"))


def token_frequency(refs: DataFrame) -> DataFrame:
    """token, n, first (ord, pos of its first occurrence)."""
    return token_rows(refs).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))


#: So many of the most frequent tokens at most are broadcast, none of more letters than this.
HEAVIEST, LETTERS = 20_000, 256


def without_heaviest(rows: DataFrame, freq: DataFrame, least: int, most: int = HEAVIEST) -> DataFrame:
    """rows (with a token) without those of the `most` most frequent tokens that freq has `least`
    times or more, dropped where the rows are made. Each token that remains has at most one in
    `most` of all occurrences, so that no key of a later join by token is hot."""
    heavy = freq.where((F.col("n") >= least) & (F.char_length("token") <= LETTERS)).orderBy(F.desc("n")).limit(most).select("token")
    return rows.join(F.broadcast(heavy), "token", "left_anti")


def frequency_statistics() -> dict[str, Column]:
    """Aggregates over token frequencies: counts and ratios, frequencies over distinct tokens
    (population deviation) and lengths over occurrences (sample deviation); null where they don't
    exist."""
    size, digit, n = F.char_length("token"), is_digit(F.col("token")), F.col("n")
    # length statistics from the distinct tokens, each weighted by its occurrences
    total, sum1, sum2 = F.sum("n"), F.sum(n * size), F.sum(n * size * size)
    variance = F.try_divide(sum2 - F.try_divide(sum1 * sum1, total), total - 1)
    return {
        "tokens": F.coalesce(total, F.lit(0)),
        "unique_tokens": F.count("*"),
        "unique_ratio": F.round(F.try_divide(F.count("*").cast("double"), total), 4),
        "numeric_tokens": F.coalesce(F.sum(F.when(digit, n)), F.lit(0)),
        "numeric_ratio": F.round(F.try_divide(F.coalesce(F.sum(F.when(digit, n)), F.lit(0)).cast("double"), total), 4),
        "min_freq": F.min("n"),
        "max_freq": F.max("n"),
        "avg_freq": F.round(F.avg("n"), 4),
        "std_freq": F.round(F.stddev_pop("n"), 4),
        "min_len": F.min(size).cast("long"),
        "max_len": F.max(size).cast("long"),
        "avg_len": F.round(F.try_divide(sum1.cast("double"), total), 4),
        "std_len": F.round(F.sqrt(F.when(variance >= 0, variance)), 4),
    }


def token_statistics(refs: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """One row: refs, and the statistics of their tokens' frequencies."""
    freq = token_frequency(refs) if freq is None else freq
    stats = freq.agg(*(c.alias(name) for name, c in frequency_statistics().items()))
    # both sides are one row
    counts = refs.agg(F.count("*").alias("refs"))
    return counts.withColumn("_k", F.lit(1)).join(stats.withColumn("_k", F.lit(1)), "_k").drop("_k")


def token_lengths(freq: DataFrame) -> DataFrame:
    """length, n: occurrences of tokens of each length."""
    return freq.groupBy(F.char_length("token").cast("long").alias("length")).agg(F.sum("n").alias("n"))


def top_tokens(freq: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tokens; of equally frequent ones those seen first."""
    return freq.orderBy(F.desc("n"), "first").limit(k)
