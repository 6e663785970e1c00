"""Scores of candidate pairs by the comparator of the parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.similarity import MATRIX_COMPARATORS, Cells, cosine
from quillmatch.plans.params import Params


def attach(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """pairs with tokens1 and tokens2."""
    left = tokens.select(F.col("refID").alias("refID1"), F.col("tokens").alias("tokens1"))
    right = tokens.select(F.col("refID").alias("refID2"), F.col("tokens").alias("tokens2"))
    return pairs.join(left, "refID1").join(right, "refID2").select("refID1", "refID2", "tokens1", "tokens2")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of pairs over all cores, whatever their bytes, and those of one reference over all tasks:
    a matrix costs far more than moving its lists, and what adaptive execution joins into few tasks
    by size would be compared by as few."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "refID1", "refID2")


def _in_batches(rows: DataFrame, ddl: str, fields: list[tuple[str, pa.DataType]], judge, none, shorter: bool, p: Params, restricted: bool, most: int = 500_000):
    """Rows are judged together as far as their matrices have `most` cells, or one row by itself. A row
    of which either list is empty gets `none`."""
    schema = pa.schema(fields)

    def run(it):
        cells = Cells(p.matrixNumTokenRule, p.matrixInitialRule, restricted)
        for batch in it:
            area = np.cumsum(pc.multiply(pc.list_value_length(batch.column(2)).cast(pa.int64()), pc.list_value_length(batch.column(3)).cast(pa.int64())).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(area, (area[at - 1] if at else 0) + most, side="right")), at + 1)
                part = batch.slice(at, to - at)
                at = to
                lists = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                values: list = [none] * len(lists)
                full = [i for i, (a, b) in enumerate(lists) if a and b]
                if full:
                    # the shorter list makes the rows where the comparator says so, the first of equal ones
                    own = [lists[i][::-1] if shorter and len(lists[i][0]) > len(lists[i][1]) else lists[i] for i in full]
                    cells.prepare(own)
                    for i, value in zip(full, judge(cells.of(own), own), strict=True):
                        values[i] = value
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, type=fields[2][1])], schema=schema)

    return _dealt(rows).mapInArrow(run, ddl)


def score(pairs: DataFrame, tokens: DataFrame, p: Params, restricted: bool = True) -> DataFrame:
    """refID1, refID2, score; 0 where either has no tokens to compare. `restricted` chooses the
    variant of the Damerau-Levenshtein distance."""
    rows = attach(pairs, tokens)
    if p.comparator == "Cosine":
        return rows.select("refID1", "refID2", cosine(F.col("tokens1"), F.col("tokens2")).alias("score"))
    (compare, shorter), mu = MATRIX_COMPARATORS[p.comparator], p.mu
    kind = [("refID1", pa.string()), ("refID2", pa.string()), ("score", pa.float64())]
    return _in_batches(rows, "refID1 string, refID2 string, score double", kind, lambda m, _: compare(m, mu).tolist(), 0.0, shorter, p, restricted)


def trace(pairs: DataFrame, tokens: DataFrame, p: Params, least: float = 0.01, restricted: bool = True) -> DataFrame:
    """The steps of the weighted matrix comparator with a similarity of at least `least`: refID1,
    refID2, step, token1, token2, sim, weight, weighted_sim, row_index, col_index."""
    step = pa.struct([("step", pa.int32()), ("token1", pa.string()), ("token2", pa.string()), ("sim", pa.float64()), ("weight", pa.float64()), ("weighted_sim", pa.float64()), ("row_index", pa.int32()), ("col_index", pa.int32())])

    def judge(m, lists):
        cells, step = m.picks()
        out: list = [[] for _ in lists]
        for k, n, i, j, v, w in zip(m.of[cells].tolist(), step.tolist(), m.row[cells].tolist(), m.col[cells].tolist(), m.values[cells].tolist(), m.weights(cells).tolist(), strict=True):
            if v >= least:
                out[k].append((n, lists[k][0][i], lists[k][1][j], v, w, v * w, i, j))
        return out

    ddl = "refID1 string, refID2 string, t array<struct<step:int,token1:string,token2:string,sim:double,weight:double,weighted_sim:double,row_index:int,col_index:int>>"
    rows = _in_batches(attach(pairs, tokens), ddl, [("refID1", pa.string()), ("refID2", pa.string()), ("t", pa.list_(step))], judge, [], True, p, restricted)
    return rows.select("refID1", "refID2", F.inline("t"))


def linked(scored: DataFrame, mu: float) -> DataFrame:
    return scored.where(F.col("score") >= mu)
