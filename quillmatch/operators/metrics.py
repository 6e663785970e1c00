"""Cluster profiles, and precision and recall of clusters and of blocking against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cluster_profile(link: DataFrame) -> DataFrame:
    """size, clusters, refs: how many clusters have each size. Of `link` (refID, clusterID) rows
    not resolved yet are one cluster."""
    sizes = link.groupBy(F.coalesce("clusterID", F.lit("")).alias("c")).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("refs"))


def profile_with_total(link: DataFrame) -> DataFrame:
    """The profile and, where size is null, its total over all sizes."""
    sizes = link.groupBy(F.coalesce("clusterID", F.lit("")).alias("c")).agg(F.count("*").alias("size"))
    return sizes.rollup("size").agg(F.count("*").alias("clusters"), F.coalesce(F.sum(sizes["size"]), F.lit(0)).alias("refs"))


def pair_sets(link: DataFrame, truth: DataFrame) -> DataFrame:
    """by, groups, refs, largest, pairs: of the references by cluster, by truth and by both, made in
    one pass over counts; pairs are those within groups: the linked, expected and true ones."""
    own = truth.select(F.col("refID").alias("_id"), F.col("truthID").alias("_t"))
    rows = link.join(own, F.col("refID") == F.col("_id"), "left").select(F.coalesce("clusterID", F.lit("")).alias("c"), F.coalesce("_t", F.lit("x")).alias("t"))
    each = rows.groupBy("c", "t").agg(F.count("*").alias("k"))
    n = each.groupingSets([[F.col("c")], [F.col("t")], [F.col("c"), F.col("t")]], F.col("c"), F.col("t")).agg(F.grouping_id("c", "t").alias("g"), F.sum("k").alias("n"))
    by = F.when(F.col("g") == 1, "cluster").when(F.col("g") == 2, "truth").otherwise("both")
    return n.groupBy(by.alias("by")).agg(F.count("*").alias("groups"), F.sum("n").alias("refs"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).cast("long").alias("pairs"))


def pair_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: the pairs within the groups."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias(name))


def _ratio(a: str, b: str):
    return F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.round(F.col(a) / F.col(b), 4))


def _f(precision, recall):
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 4))


def er_metrics(link: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_pairs, expected_pairs, linked_pairs, precision, recall, f_measure. References
    without a truth have one truth in common; those not resolved one cluster."""
    own = truth.select(F.col("refID").alias("_id"), F.col("truthID").alias("_t"))
    rows = link.join(own, F.col("refID") == F.col("_id"), "left").select(F.coalesce("clusterID", F.lit("")).alias("c"), F.coalesce("_t", F.lit("x")).alias("t"))
    each = rows.groupBy("c", "t").agg(F.count("*").alias("n"))

    def pairs(df: DataFrame):
        return df.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("v"))

    parts = [("true_pairs", each), ("expected_pairs", each.groupBy("t").agg(F.sum("n").alias("n"))), ("linked_pairs", each.groupBy("c").agg(F.sum("n").alias("n")))]
    named = None
    for name, df in parts:
        row = pairs(df).select(F.lit(name).alias("name"), "v")
        named = row if named is None else named.unionByName(row)
    counts = named.groupBy().pivot("name", [name for name, _ in parts]).agg(F.max("v"))
    return _with_ratios(counts, "linked_pairs")


def _with_ratios(counts: DataFrame, found: str) -> DataFrame:
    rows = counts.withColumn("precision", _ratio("true_pairs", found)).withColumn("recall", _ratio("true_pairs", "expected_pairs"))
    return rows.withColumn("f_measure", _f(F.col("precision"), F.col("recall")))


def blocking_metrics(pairs: DataFrame, refs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_pairs, expected_pairs, candidate_pairs, precision, recall, f_measure.
    Expected are the pairs of equal truth among the references; a reference's pair with itself
    counts as a candidate, and as true if it has a truth."""
    known = truth.join(refs.select("refID"), "refID", "left_semi")
    a = known.select(F.col("refID").alias("refID1"), F.col("truthID").alias("t1"))
    b = known.select(F.col("refID").alias("refID2"), F.col("truthID").alias("t2"))
    found = pairs.join(a, "refID1", "left").join(b, "refID2", "left")
    counts = found.agg(F.count_if(F.col("t1") == F.col("t2")).alias("true_pairs"), F.count("*").alias("candidate_pairs"))
    expected = pair_count(known, ["truthID"], "expected_pairs")
    # both sides are one row
    joined = counts.withColumn("_k", F.lit(1)).join(expected.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return _with_ratios(joined, "candidate_pairs").select("true_pairs", "expected_pairs", "candidate_pairs", "precision", "recall", "f_measure")


def quality_counters(epsilon: float) -> dict[str, Column]:
    """Aggregates over clusters (size, quality): clusters, refs, clusters of several members, and of
    good quality with their refs."""
    good = F.col("quality") >= epsilon
    return {
        "clusters": F.count("*"),
        "refs": F.coalesce(F.sum("size"), F.lit(0)),
        "several": F.count_if(F.col("size") > 1),
        "good_clusters": F.count_if(good),
        "good_refs": F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)),
    }


def iteration_counters(quality: DataFrame, epsilon: float) -> DataFrame:
    """One row of quality_counters."""
    return quality.agg(*(c.alias(name) for name, c in quality_counters(epsilon).items()))
