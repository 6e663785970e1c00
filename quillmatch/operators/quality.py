"""Entropy quality of clusters.

The i-th occurrence of a token in one member matches the i-th in every other one that has so many,
so the matches of a token fall into layers, and the entropy is a sum over (token, layer) groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import split_name_address

#: Weights of the two halves of a reference.
NAME, ADDRESS = 0.76, 0.24


def entropy_quality(clusters: DataFrame, refs: DataFrame, halves: bool = True) -> DataFrame:
    """clusterID, size, quality of clusters (clusterID, refID), 1 for one of a single member.

    Members are split before their first token with a digit; a half has quality 1 if it has no
    tokens, and of two halves with tokens the weighted mean counts. Without `halves`, members stay
    whole and one quality is taken over all of their tokens."""
    sizes = clusters.groupBy("clusterID").agg(F.count("*").alias("size"))
    many = sizes.where("size > 1")
    name, address = split_name_address(F.col("tokens"))
    members = clusters.join(many, "clusterID").join(refs.select("refID", "tokens"), "refID")
    parts = (name, address) if halves else (F.col("tokens"),)
    rows = members.select("clusterID", "size", "refID", F.explode(F.array(*(F.struct(F.lit(i).alias("half"), t.alias("t")) for i, t in enumerate(parts)))).alias("h"))
    tokens = rows.select("clusterID", "size", "refID", F.col("h.half").alias("half"), F.explode("h.t").alias("token"))
    # a token of count m in a member stands in its layers 1 to m
    counts = tokens.groupBy("clusterID", "size", "half", "refID", "token").agg(F.count("*").cast("int").alias("m"))
    layers = counts.select("clusterID", "size", "half", "token", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("layer"))
    groups = layers.groupBy("clusterID", "size", "half", "token", "layer").agg(F.count("*").alias("c"))
    share = F.col("c") / F.col("size")
    sums = groups.groupBy("clusterID", "size", "half").agg(F.sum("c").alias("tokens"), F.sum(-share * F.log2(share)).alias("entropy"))
    base = F.col("tokens") * F.log2(F.col("size").cast("double")) / F.col("size")
    each = sums.select("clusterID", "half", (1 - F.col("entropy") / base).alias("q"))
    halves_q = each.groupBy("clusterID").agg(F.max(F.when(F.col("half") == 0, F.col("q"))).alias("name"), F.max(F.when(F.col("half") == 1, F.col("q"))).alias("address"))
    both = NAME * F.col("name") + ADDRESS * F.col("address")
    quality = F.coalesce(both, F.col("name"), F.col("address"), F.lit(1.0))
    return sizes.join(halves_q, "clusterID", "left").select("clusterID", "size", quality.alias("quality"))

