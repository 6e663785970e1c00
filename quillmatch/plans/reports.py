"""Captures, reports and files of a run; each is a DataFrame first, and a writer for it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import split_name_address
from quillmatch.operators.blocking import comparison_tokens
from quillmatch.operators.scoring import attach, score, trace
from quillmatch.operators.stats import token_statistics
from quillmatch.plans.params import Params
from quillmatch.plans.resolve import Resolution
from quillmatch.sources.workbook import Workbook

#: The columns of a report row.
REPORT_COLUMNS = (
    "Sample", "precision", "recall", "F-meas", "linkedPairs", "expectedPairs", "truePairs", "tokenizerType", "nbr_Refs", "total_Tokens", "unique_Tokens", "unique_Ratio",
    "total_Numeric", "numeric_Ratio", "min_Freq", "max_Freq", "avg_Freq", "stdev_Freq", "min_Len", "max_Len", "avg_Len", "stdev_Len", "run_Global_Correction",
    "min_Freq_Std_Token", "min_Len_Std_Token", "max_Freq_Err_Token", "beta", "block_By_Pairs", "min_Blk_Token_Len", "exclude_Numeric_Blocks", "sigma",
    "remove_Duplicate_Tokens", "remove_Excluded_Blk_Tokens", "epsilon", "epsilon_Iterate", "mu", "mu_Iterate", "comparator", "matrix_Num_Token_Rule",
    "matrix_Initial_Rule", "blockCorrection",
)


def link_index(link: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """refID, clusterID (its own id where open) and, with refs, the tokens in one string."""
    out = link.select("refID", F.coalesce("clusterID", "refID").alias("clusterID"))
    if refs is None:
        return out
    tokens = refs.select(F.col("refID").alias("_id"), F.array_join("tokens", " ").alias("tokens"))
    return out.join(tokens, F.col("refID") == F.col("_id"), "left").select("refID", "clusterID", F.coalesce("tokens", F.lit("")).alias("tokens"))


def link_index_lines(link: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """One column, `value`: the lines of a link-index file by refID, without its header."""
    rows = link_index(link, refs)
    return rows.orderBy("refID").select(F.concat_ws(", ", *rows.columns).alias("value"))


def ref_capture(refs: DataFrame) -> DataFrame:
    return refs.select("refID", F.array_join("tokens", ", ").alias("tokens"))


def token_capture(freq: DataFrame) -> DataFrame:
    return freq.select("token", "n").orderBy(F.desc("n"), "token")


def _truths(rows: DataFrame, truth: DataFrame | None) -> DataFrame:
    if truth is None:
        return rows
    a = truth.select(F.col("refID").alias("_i1"), F.col("truthID").alias("_t1"))
    b = truth.select(F.col("refID").alias("_i2"), F.col("truthID").alias("_t2"))
    joined = rows.join(a, F.col("refID1") == F.col("_i1"), "left").join(b, F.col("refID2") == F.col("_i2"), "left")
    return joined.select(*rows.columns, F.coalesce(F.col("_t1") == F.col("_t2"), F.lit(False)).cast("int").alias("truth"))


def pair_capture(pairs: DataFrame, refs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """refID1, refID2, tokens1, tokens2 (in one string each) and truth, 1 where both have the same."""
    rows = attach(pairs, refs).select("refID1", "refID2", F.array_join("tokens1", ", ").alias("tokens1"), F.array_join("tokens2", ", ").alias("tokens2"))
    return _truths(rows, truth)


def cluster_capture(clusters: DataFrame, refs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """clusterID, refID, tokens and truth: 1 where a member's truth is that of the cluster, which is
    its name's truth, else that of the first member that has one."""
    tokens = refs.select(F.col("refID").alias("_id"), F.array_join("tokens", ", ").alias("tokens"))
    rows = clusters.join(tokens, F.col("refID") == F.col("_id"), "left").select("clusterID", "refID", F.coalesce("tokens", F.lit("")).alias("tokens"))
    if truth is None:
        return rows
    known = truth.select(F.col("refID").alias("_r"), F.col("truthID").alias("_t"))
    rows = rows.join(known, F.col("refID") == F.col("_r"), "left").drop("_r")
    # partial aggregates, so that a large cluster isn't gathered in one task
    first = rows.where("_t IS NOT NULL").groupBy("clusterID").agg(F.max(F.when(F.col("refID") == F.col("clusterID"), F.col("_t"))).alias("_own"), F.min_by("_t", "refID").alias("_first"))
    named = first.select(F.col("clusterID").alias("_c"), F.coalesce("_own", "_first").alias("_ct"))
    return rows.join(named, F.col("clusterID") == F.col("_c"), "left").select("clusterID", "refID", "tokens", F.coalesce(F.col("_t") == F.col("_ct"), F.lit(False)).cast("int").alias("truth"))


def cluster_json(clusters: DataFrame, refs: DataFrame) -> DataFrame:
    """clusterID, records: the members of a cluster by name and address, with their refIDs."""
    name, address = split_name_address(F.col("tokens"))
    rows = clusters.join(refs.select("refID", "tokens"), "refID").select("clusterID", "refID", F.array_join(name, " ").alias("name"), F.array_join(address, " ").alias("address"))
    records = rows.groupBy("clusterID", "name", "address").agg(F.array_join(F.array_sort(F.collect_set("refID")), ", ").alias("refIDs"))
    out = records.groupBy("clusterID").agg(F.array_sort(F.collect_list(F.struct("name", "address", "refIDs"))).alias("r"))
    return out.select("clusterID", F.transform("r", lambda x: F.struct(x["refIDs"].alias("refIDs"), x["name"].alias("name"), x["address"].alias("address"))).alias("records"))


def pair_comparison(pairs: DataFrame, refs: DataFrame, freq: DataFrame, p: Params, truth: DataFrame | None = None, restricted: bool = True) -> DataFrame:
    """refID1, refID2, the tokens that are compared, similarity, mu and truth."""
    tokens = comparison_tokens(refs, freq, p)
    scored = score(pairs, tokens, p, restricted).select(F.col("refID1").alias("_a"), F.col("refID2").alias("_b"), F.col("score").alias("similarity"))
    rows = attach(pairs, tokens).join(scored, (F.col("refID1") == F.col("_a")) & (F.col("refID2") == F.col("_b")))
    rows = rows.select("refID1", "refID2", F.array_join("tokens1", ", ").alias("tokens1"), F.array_join("tokens2", ", ").alias("tokens2"), "similarity", F.lit(p.mu).alias("mu"))
    return _truths(rows, truth)


def token_matches(pairs: DataFrame, refs: DataFrame, freq: DataFrame, p: Params, least: float = 0.01, restricted: bool = True) -> DataFrame:
    return trace(pairs, comparison_tokens(refs, freq, p), p, least, restricted)


def report_row(result: Resolution, metrics: DataFrame | None) -> DataFrame:
    """One row of the report's columns; without a truth its metrics are null. Of mu and epsilon it
    has the first values, or the last ones if iterations are profiled."""
    p, spark = result.params, result.link.sparkSession
    end = result.iterations[-1] if p.runIterationProfile and result.iterations else None
    stats = token_statistics(result.refs, result.freq)
    if metrics is None:
        metrics = spark.range(1).select(*(F.lit(None).cast(kind).alias(c) for c, kind in (("true_pairs", "long"), ("expected_pairs", "long"), ("linked_pairs", "long"), ("precision", "double"), ("recall", "double"), ("f_measure", "double"))))
    one = stats.withColumn("_k", F.lit(1)).join(metrics.withColumn("_k", F.lit(1)), "_k")
    values = [
        F.lit(p.inputFileName), F.col("precision"), F.col("recall"), F.col("f_measure"), F.col("linked_pairs"), F.col("expected_pairs"), F.col("true_pairs"), F.lit(p.tokenizerType),
        *(F.col(c) for c in ("refs", "tokens", "unique_tokens", "unique_ratio", "numeric_tokens", "numeric_ratio", "min_freq", "max_freq", "avg_freq", "std_freq", "min_len", "max_len", "avg_len", "std_len")),
        *(F.lit(v) for v in (p.runGlobalCorrection, p.minFreqStdToken, p.minLenStdToken, p.maxFreqErrToken, p.beta, p.blockByPairs, p.minBlkTokenLen, p.excludeNumericBlocks, p.sigma, p.removeDuplicateTokens, p.removeExcludedBlkTokens)),
        *(F.lit(v) for v in (end.epsilon if end else p.epsilon, p.epsilonIterate, end.mu if end else p.mu, p.muIterate, p.comparator, p.matrixNumTokenRule, p.matrixInitialRule, p.blockCorrection)),
    ]
    return one.select(*(v.alias(n) for v, n in zip(values, REPORT_COLUMNS, strict=True)))


def run_log(result: Resolution) -> DataFrame:
    """stage, iteration, name, value: what a run counted. Statistics of the tokens as read and, where
    they were corrected, after that; of each round the thresholds, pairs, blocks' measures, links,
    clusters and those kept; the sizes of the final clusters. All of it was seen while the run's
    tables were written, so the log needs no job of its own."""
    rows = [("end", len(result.iterations), result.ended or "", 0.0)]

    def add(stage: str, number: int, values: dict) -> None:
        rows.extend((stage, number, name, None if v is None else float(v)) for name, v in values.items())

    for stage in ("tokens_read", "global_correction", "block_correction", "tokens_corrected", "clusters"):
        add(stage, 0, result.seen.get(stage, {}))
    if result.global_edits is not None:
        add("global_correction", 0, {"refs_changed": result.refs_changed})
    for i in result.iterations:
        add("iteration", i.number, {"mu": i.mu, "epsilon": i.epsilon} | {name: i.seen[name]["n"] for name in ("pairs", "pairs_before_correction", "links", "clustered") if name in i.seen})
        for stage in ("quality", "blocking", "metrics"):
            add(stage, i.number, i.seen.get(stage, {}))
    return result.link.sparkSession.createDataFrame(rows, "stage string, iteration int, name string, value double")


def capture_path(folder: str, base: str, tag: str, iteration: int | None = None) -> str:
    """Where a run's captures go, or an iteration's."""
    path = f"{folder.rstrip('/')}/{base}_{tag}"
    return path if iteration is None else f"{path}/iteration_{iteration:02d}"


def write_link_index(link: DataFrame, path: str, refs: DataFrame | None = None) -> None:
    """Text files of lines by refID, the header before the first of them."""
    header = "RefID, ClusterID" + ("" if refs is None else ", Tokens")
    rows = link_index(link, refs)
    lines = rows.select("refID", F.concat_ws(", ", *rows.columns).alias("value"))
    head = link.sparkSession.createDataFrame([(None, header)], "refID string, value string")
    # nulls sort first
    lines.unionByName(head).orderBy("refID").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_report(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", True).csv(path)


def append_workbook(rows: DataFrame, path: str) -> None:
    """Report rows below those that a spreadsheet has."""
    rows.sparkSession.dataSource.register(Workbook)
    rows.write.format("workbook").mode("append").save(path)


def write_variants(variants: DataFrame, path: str) -> None:
    """A JSON object by standard, indented, as read_variants() reads it. It is made on the driver:
    variants are a small, curated table."""
    data = {r["std"]: list(r["variants"]) for r in variants.collect()}
    text = json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False)
    variants.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
