"""Transitive closure of links: connected components by local forests and alternating stars.

Each task first joins the links it holds, `chunk` at a time, into trees that hang on their smallest
node (union by pointer jumping over arrays), so that cycles and repeated paths end there and what is
left to shuffle are at most as many links as nodes. Where all links fit one chunk that is the closure
already. Else alternating stars follow (Kiveris et al., 2014): a large star joins each node's larger
neighbours to its smallest one, a small star does so for the smaller neighbours, and rounds go on
until the links no longer change, when every node hangs on the smallest node of its component.

A star needs a node's smallest neighbour beside each of its links. Nodes of more than `hub` links
aren't shuffled to: their smallest neighbours are broadcast, which are few, as all nodes have twice
as many links together as there are; `hub` grows with the links so that there are never more than
`MAX_HUBS`. All other nodes meet their links by a join, none of more than `hub` rows.

Rounds follow the logarithm of a component's width; nothing is collected but counts and a checksum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.staging import staged, unstage

#: Links that a task joins at once, the links from which a node is a hub, and the hubs there can be.
CHUNK, HUB, MAX_HUBS = 500_000, 50_000, 20_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is connected with by the links u-v."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(u, v)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while True:  # to the end of each path
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def forest(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """Links (u, v) of each node with the smallest node that the batches' links connect it with."""
    both = pa.chunked_array([c for b in batches for c in b.columns]).combine_chunks()
    coded = both.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    code = rank[coded.indices.to_numpy()]
    ends = np.cumsum([b.num_rows for b in batches for _ in b.columns])
    parts = np.split(code, ends[:-1])
    root = roots(np.concatenate(parts[0::2]), np.concatenate(parts[1::2]), len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(root[own]))], schema=schema)


def contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """The links that are left when each task has joined what it holds, `chunk` links at a time."""

    def run(it: Iterator[pa.RecordBatch]):
        held, rows = [], 0
        for batch in it:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= chunk:
                yield forest(held, held[0].schema)
                held, rows = [], 0
        if held:
            yield forest(held, held[0].schema)

    return edges.mapInArrow(run, edges.schema)


def _with_lowest(rows: DataFrame, low: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with the m of low (k, m, n) for k = u: those of hubs, and all others."""
    hubs = F.broadcast(low.where(F.col("n") > hub).select(F.col("k").alias("_hub"), F.col("m").alias("_m")))
    told = rows.join(hubs, rows["u"] == F.col("_hub"), "left")
    rest = told.where("_hub IS NULL").select("u", "v")
    return told.where("_hub IS NOT NULL").select("u", "v", F.col("_m").alias("m")), rest.join(low.where(F.col("n") <= hub), F.col("u") == F.col("k")).select("u", "v", "m")


def _large_star(edges: DataFrame, hub: int, keep) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n"))
    hot, rest = _with_lowest(both.where("v > u"), low, hub)
    return hot.unionByName(rest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), low


def _small_star(edges: DataFrame, hub: int, keep) -> tuple[DataFrame, DataFrame]:
    """edges hold u > v."""
    low = keep(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hot, rest = _with_lowest(edges, low, hub)
    out = hot.unionByName(rest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), low


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame], DataFrame] = staged, drop: Callable[[DataFrame], None] = unstage, chunk: int = CHUNK, hub: int = HUB) -> DataFrame:
    """node, component for every node of a link; the component is its smallest node.

    Links with a null end are ignored; a link of a node with itself gives that node alone;
    repeated and reversed links count once. `keep` cuts lineage after each step."""
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = keep(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    linked = edges.where("u > v")
    parts = max(1, -(-linked.count() // chunk))
    now = keep(contracted(linked.repartition(parts), chunk))
    if parts > 1:
        now = _stars(now, keep, drop, hub)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(tops)
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def _stars(edges: DataFrame, keep, drop, hub: int) -> DataFrame:
    """Rounds of stars until nothing changes."""
    now, before = edges, _sum(edges)
    while True:
        most = max(hub, 2 * before[0] // MAX_HUBS)
        large, low = _large_star(now, most, keep)
        large = keep(large)
        small, other = _small_star(large, most, keep)
        after = keep(small)
        state = _sum(after)
        for x in (now, large, low, other):
            drop(x)
        now = after
        if state == before:
            return now
        before = state
