"""References as a stream: files that arrive in a folder are parsed and tokenized as they come, and
token frequencies are kept up to date. Resolution itself is a batch job, since every round needs the
frequencies of all references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions.text import tokenizer
from quillmatch.plans.params import Params
from quillmatch.sources.readers import parse_lines


def read_stream(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    """refID, tokens of the lines of new files; header lines can't be told apart in a stream, so
    files come without them. A line's order is unknown here."""
    lines = spark.readStream.text(folder).select("value", F.lit(0).cast("long").alias("ord"))
    rows = parse_lines(lines, p.delimiter).where("NOT malformed")
    tokens = tokenizer(p.tokenizerType)(F.col("body"), p.delimiter)
    return rows.select("refID", (F.array_distinct(tokens) if p.removeDuplicateTokens else tokens).alias("tokens"))


def running_frequency(refs: DataFrame) -> DataFrame:
    """token, n so far; for a sink in complete or update mode."""
    return refs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
