"""Inputs of a run: references, truth, word list, aliases, variants."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.plans.staging import staged

#: White space that is stripped from lines, but for a delimiter.
BLANKS = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"
#: Blocks of files up to which their line numbers are broadcast.
BROADCAST_BLOCKS = 200_000


def parse_lines(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """refID, body, ord, malformed of lines (value, ord).

    The id is what stands before the first delimiter, the body all behind it. A line without a
    delimiter is malformed: its id is the line but for its last character, its body the line."""
    line = F.btrim(F.col("value"), F.lit("".join(c for c in BLANKS if c not in delimiter)))
    at = F.instr(line, delimiter)
    bad = at == 0
    ref = F.when(bad, F.substring(line, F.lit(1), F.greatest(F.length(line) - 1, F.lit(0)))).otherwise(F.substring(line, F.lit(1), at - 1))
    body = F.when(bad, line).otherwise(F.substring(line, at + F.length(F.lit(delimiter)), F.length(line)))
    return lines.select(ref.alias("refID"), body.alias("body"), "ord", bad.alias("malformed"))


def numbered_lines(spark: SparkSession, path: str | list[str], few: int = BROADCAST_BLOCKS) -> DataFrame:
    """value, ord, first of text files: ord counts lines through all files in the order of their
    names, first is true of each file's first line. Files are read in blocks by as many tasks; lines
    are counted for each block first, and a line's number is its block's start and its place there."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    blocks = staged(lines.groupBy("file", "block").agg(F.min("i").alias("low"), F.count("*").alias("n")), blocks=F.count("*"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "low", F.coalesce(before, F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if blocks.seen["blocks"] <= few else starts
    rows = lines.join(starts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return rows.select("value", (F.col("before") + F.col("i") - F.col("low")).alias("ord"), ((F.col("block") == 0) & (F.col("i") == F.col("low"))).alias("first"))


def read_references(spark: SparkSession, path: str | list[str], delimiter: str = ",", has_header: bool = False) -> DataFrame:
    """refID, body, ord, malformed of delimited text files; carriage returns, line feeds and both end
    lines. ord is the line's place, and a header is the first line of each file."""
    rows = numbered_lines(spark, path)
    return parse_lines(rows.where("NOT first") if has_header else rows, delimiter)


def from_table(df: DataFrame, ref: str, body: str, ord_: str | None = None) -> DataFrame:
    """refID, body, ord of a table: any Spark source can hold references."""
    return df.select(F.col(ref).cast("string").alias("refID"), F.col(body).cast("string").alias("body"), F.col(ord_ or ref).alias("ord"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it comes in fewer parts than there are: a small file, or one
    of few row groups. A large table comes in more parts and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def resolve_duplicates(refs: DataFrame) -> DataFrame:
    """One row for each refID: the last one's tokens, at the place of the first."""
    return refs.groupBy("refID").agg(F.max_by("tokens", "ord").alias("tokens"), F.min("ord").alias("ord"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """word, up to the first blank line."""
    rows = spark.read.text(path).select(F.trim("value").alias("word"), F.monotonically_increasing_id().alias("ord"))
    end = rows.where("word = ''").agg(F.min("ord").alias("end"))
    stop = end.first()["end"]
    return (rows if stop is None else rows.where(F.col("ord") < stop)).select("word").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, value; of several rows for an alias the last holds. All rows are data."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("v"), F.monotonically_increasing_id().alias("ord"))
    rows = rows.where(F.size("v") >= 2).select(F.col("v")[0].alias("value"), F.col("v")[1].alias("alias"), "ord")
    return rows.groupBy("alias").agg(F.max_by("value", "ord").alias("value"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """std, variant of a JSON object {standard: [variants]}; a missing or malformed file has none,
    and values that aren't lists are skipped."""
    schema = "std string, variant string"
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        data = json.loads(text)
    except Exception:  # noqa: BLE001  missing and malformed alike
        data = {}
    pairs = [(k, v) for k, vs in data.items() if isinstance(vs, list) for v in vs] if isinstance(data, dict) else []
    return spark.createDataFrame(pairs, schema)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """refID, truthID: the first two columns behind a header, up to the first blank line."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    stop = rows.where(F.trim("value") == "").agg(F.min("ord").alias("m")).first()["m"]
    rows = rows.where("ord > 0") if stop is None else rows.where((F.col("ord") > 0) & (F.col("ord") < stop))
    cells = F.split("value", ",")
    rows = rows.where(F.size(cells) >= 2).select(F.trim(cells[0]).alias("refID"), F.trim(cells[1]).alias("truthID"), "ord")
    return rows.groupBy("refID").agg(F.max_by("truthID", "ord").alias("truthID"))

