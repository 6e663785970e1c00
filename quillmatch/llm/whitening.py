"""Whitening of embeddings by LOBPCG (Knyazev, 2001).

Each entry c becomes the integer x = floor(64 c) + 1000000, and each distinct x vector counts once:
the fit list. Its covariance V (divisor n) is never formed: V times a block of directions is the sum
over tasks of C'(C B), where C holds centred rows. The leading eigenvectors come from iterations
over three blocks, the iterate X, its residuals R = VX - X diag(e), and the previous directions P:
R and P are made orthonormal to X and to each other, one pass over the fit list multiplies them, and
a Rayleigh-Ritz step on the span of all three gives the next iterate, its product with V and P.
Where the residuals that follow from these seem small enough, VX is multiplied anew, and the
iteration ends only if the residuals of that product are at most `TOLERANCE` of the greatest
eigenvalue. Some directions beyond the wanted ones (`GUARD`) are iterated along, so that the last
wanted one doesn't wait for a close neighbour.

A task holds a batch of rows and sums of the block's size; sums of tasks are added by a shuffle on
the entry, and the driver holds blocks of (dimensions x directions) alone. Sums that have to be
exact are decimals or integers.

Defined results: a null vector, an empty one, one that holds a null, NaN or an infinity, or an entry
whose x is no long (beyond 2^61) is dropped, and so are vectors of another length than the most
frequent one (of equally frequent lengths the smallest); repeated rows, and equal, null or repeated
ids, each get their rows. Components whose eigenvalue is zero but for rounding (at most `RANK` of
the greatest) are left out, so that one vector alone, or equal ones, give no rows, and an empty table
none either. Components of equal eigenvalues are one basis of their space. A component's sign is
such that its entry of greatest size is positive. A deviation beyond a long is null. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.staging import staged

from .common import arrow_schema, bounded_batches, id_type

COMPONENTS = 16
GUARD = 8
SHIFT = 1_000_000
TOLERANCE = 1e-12
RANK = 1e-12
PASSES = 400
#: Rows that a task multiplies at once.
ROWS = 4096


def _long_vectors(vectors: pa.Array, dim: int) -> np.ndarray:
    """x less SHIFT of a list column without nulls."""
    c = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    return np.floor(64 * c).astype(np.int64)


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vectors have only entries that become a long."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 55), F.lit(False)))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fits)


def _dimension(rows: DataFrame, vector: str) -> int:
    row = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return 0 if row is None else row["d"]


def fit_list(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """x: each distinct vector of longs (less SHIFT) once, as bytes."""
    schema = arrow_schema("x binary")

    def run(it):
        for batch in it:
            x = _long_vectors(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], type=pa.binary())], schema=schema)

    return rows.select(vector).mapInArrow(run, "x binary").distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, dim)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each entry."""
    ddl = "at int, v string"
    schema = arrow_schema(ddl)

    def run(it):
        n, total = 0, [0] * dim
        for batch in it:
            x = _matrix(batch.column(0), dim)
            if len(x):
                small = int(np.abs(x).max()) <= (1 << 62) // len(x)
                part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
                n, total = n + len(x), [a + int(b) for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], type=pa.int32()), pa.array([str(n), *map(str, total)])], schema=schema)

    sums = fit.mapInArrow(run, ddl).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r["at"]: int(r["v"]) for r in sums}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


class Centre:
    """Rows less their mean: first the mean's whole part as an integer, then the rest."""

    def __init__(self, n: int, total: list[int]):
        self.whole = np.array([t // n for t in total], dtype=np.int64)
        self.rest = np.array([(t % n) / n for t in total])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def product(fit: DataFrame, centre: Centre, n: int, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V times a block of directions, and the trace of V."""
    dim, width = block.shape
    held = fit.sparkSession.sparkContext.broadcast((centre, block))
    ddl = "at int, v double"
    schema = arrow_schema(ddl)

    def run(it):
        c, b = held.value
        total, trace = np.zeros((dim, width)), 0.0
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                rows = c(_matrix(batch.column(0).slice(at, ROWS), dim))
                total += rows.T @ (rows @ b)
                trace += float(np.vdot(rows, rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size), type=pa.int32()), pa.array(np.concatenate([[trace], total.ravel()]))], schema=schema)

    found = np.zeros(dim * width + 1)
    for r in fit.mapInArrow(run, ddl).groupBy("at").agg(F.sum("v").alias("v")).collect():
        found[r["at"] + 1] = r["v"]
    held.unpersist()
    return found[1:].reshape(dim, width) / n, float(found[0]) / n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's span outside of that of `against`."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more for what rounding leaves
        block = block - against @ (against.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(float(s[0]), 1e-3)]
    return block


def _found(e, x, vx, size, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return e[:wanted], x[:, :wanted], vx[:, :wanted], size[:wanted]


def lobpcg(multiply, dim: int, wanted: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors, their products with the matrix, and their residuals
    relative to the greatest eigenvalue. multiply(block) is the matrix times a block of columns."""
    wanted = min(wanted, dim)
    width = min(dim, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, width)))[0]
    vx, p, fresh, certified = multiply(x), np.zeros((dim, 0)), True, None
    for _ in range(passes):
        t = x.T @ vx
        e, c = np.linalg.eigh((t + t.T) / 2)
        e, c = e[::-1], c[:, ::-1]
        x, vx = x @ c, vx @ c
        r = vx - x * e
        size = np.linalg.norm(r, axis=0) / max(float(e[0]), np.finfo(float).tiny)
        if size[:wanted].max() <= tolerance:
            if not fresh:
                x = np.linalg.qr(x)[0]
                vx, fresh = multiply(x), True  # certified by a product of its own
                continue
            largest = float(size[:wanted].max())
            if largest <= 1e-15 or (certified is not None and largest > certified[0] / 2):
                return certified[1] if certified is not None and certified[0] < largest else _found(e, x, vx, size, wanted)
            certified = largest, _found(e, x, vx, size, wanted)
        more = _orthonormal(np.hstack([r, p]), x)
        if not more.shape[1]:  # rounding has left nothing to search in
            if fresh and certified is not None:
                return certified[1]
            if fresh:
                break
            vx, fresh = multiply(x), True
            continue
        vmore = multiply(more)
        basis, vbasis = np.hstack([x, more]), np.hstack([vx, vmore])
        t = basis.T @ vbasis
        e, c = np.linalg.eigh((t + t.T) / 2)
        c = c[:, ::-1][:, :width]
        p, x, vx, fresh = more @ c[width:], basis @ c, vbasis @ c, False
    raise RuntimeError(f"no eigenvectors with residuals of {tolerance} after {passes} passes")


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: for each valid
    row and component; residual is that of the component, relative to the greatest eigenvalue."""
    bounded_batches(rows.sparkSession)
    ddl = f"`{vec_id}` {id_type(rows, vec_id)}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    good = valid(rows.select(vec_id, vector), vector)
    dim = _dimension(good, vector)
    good = good.where(F.size(vector) == dim)
    none = rows.sparkSession.createDataFrame([], ddl)
    if not dim:
        return none
    fit = staged(fit_list(good, vector, dim))
    n, total = _exact_sums(fit, dim)
    centre, traces = Centre(n, total), []

    def multiply(block):
        out, trace = product(fit, centre, n, block)
        traces.append(trace)
        return out

    e, u, vu, residual = lobpcg(multiply, dim, components, **options)
    kept = int((e > RANK * e[0]).sum())
    if not kept:
        return none
    e, u, vu, residual = e[:kept], u[:, :kept], vu[:, :kept], residual[:kept]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(kept)])
    scale = sign / np.sqrt(e)
    error = float(np.abs((u * scale).T @ (vu * scale) - np.eye(kept)).max())
    explained = e / traces[0]
    held = rows.sparkSession.sparkContext.broadcast((centre, u * scale, total))
    schema = arrow_schema(ddl)

    def run(it):
        c, w, sums = held.value
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _long_vectors(batch.column(1), dim)
                m = len(x)
                out = np.ascontiguousarray(c(x) @ w).ravel()
                own = np.repeat(np.arange(m), kept)
                columns = [batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), _deviations(x, n, sums).take(pa.array(own)), pa.array(out)]
                columns += [pa.array(np.tile(v, m)) for v in (explained, np.full(kept, error), residual)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return good.mapInArrow(run, ddl)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """For each row the sum of (n * x - total)^2, exactly; null where it is no long."""
    most, sums = max(int(np.abs(x).max(initial=0)), 1), max(max(map(abs, total)), 1)
    if most * max(most, sums) * x.shape[1] < 1 << 62:
        squares, mixed = (x * x).sum(axis=1).tolist(), (x @ np.array(total, dtype=np.int64)).tolist()
    else:
        rows = x.tolist()
        squares, mixed = [sum(a * a for a in r) for r in rows], [sum(a * t for a, t in zip(r, total, strict=True)) for r in rows]
    constant = sum(t * t for t in total)
    found = (n * n * q - 2 * n * m + constant for q, m in zip(squares, mixed, strict=True))
    return pa.array([v if v < 1 << 63 else None for v in found], type=pa.int64())
