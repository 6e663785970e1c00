"""What the operators share: inputs, and text as bytes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

MASK = (1 << 64) - 1

#: A-Z to a-z, all other bytes as they are; bytes above 0x7F belong to multi-byte characters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The base of polynomial hashes modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base to the powers 0..n modulo 2**64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in BASE with these coefficients."""
    terms = values * powers(max(len(values) - 1, 0), BASE)[: len(values)]
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of runs of bytes, raw[start:end]: polynomials, mixed. They are made over about
    `step` bytes at once, or one run, so that memory doesn't grow with the text."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(int(np.searchsorted(end, at + step, side="right")), i + 1)
        sums = prefix_sums(raw[at : int(end[j - 1])].astype(np.uint64))
        a, b = start[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[b] - sums[a]) * powers(int(a[-1]), INVERSE)[a] + (b - a).astype(np.uint64))
        i = j
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema, as mapInArrow returns it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that hashed_words() gives to these words."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    return run_hashes(np.frombuffer(b" ".join(words), dtype=np.uint8), end - size, end)


def hashed_words(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts in a row (parted by ASCII white space, A-Z lower-cased), and
    how many each text has."""
    size = np.array([len(t or b"") for t in batch], dtype=np.int64)
    raw = np.frombuffer((b" " + b" ".join([t or b"" for t in batch]) + b" ").translate(LOWER), dtype=np.uint8)
    word = ~_SPACE[raw]
    start, end = (np.flatnonzero(x) + 1 for x in (word[1:] & ~word[:-1], ~word[1:] & word[:-1]))
    of = np.searchsorted(np.cumsum(size + 1), start, side="right")
    return run_hashes(raw, start, end), np.bincount(of, minlength=len(batch))


#: Bytes of rows that Spark hands to a Python worker at once, where the session doesn't say.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows alone unless the session bounds their bytes, and thousands of
    long texts don't fit beside an executor's heap. A bound that is set stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def by_text(docs: DataFrame, carry: list[str], extra: str, make) -> DataFrame:
    """The columns `carry` of docs and those of the DDL `extra`, which a function of texts fills:
    make() is called once in each task and returns a function from a list of texts (bytes or None)
    to a list of columns. Rows go back a slice at a time, so that a worker holds little more than
    the batch it got. A carried column that is named as an extra one is replaced."""
    bounded_batches(docs.sparkSession)
    added = arrow_schema(extra)
    carry = [c for c in carry if c not in added.names]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), extra])

    def run(it):
        fill = make()
        for batch in slices(it):
            own = [batch.schema.get_field_index(c) for c in carry]
            new = [pa.array(c, type=f.type) for c, f in zip(fill(texts(batch)), added, strict=True)]
            schema = pa.schema([*(batch.schema.field(i) for i in own), *added])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *new], schema=schema)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, ddl)


def slices(it, size: int = 1_000_000, column: int | None = None):
    """Batches of about so many bytes of text, or one text. `column`: where the text is, if it isn't
    named so."""
    for batch in it:
        text = batch.column(batch.schema.get_field_index("text") if column is None else column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def trimmed(it):
    """Batches, after each of which the memory that it needed and no longer needs goes back to the
    system: a worker process serves one stage after another, and would keep the most that any
    of them took."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in it:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if give_back is not None:
            give_back(0)


def columns_of(rows: list[tuple], n: int) -> list:
    """Rows as n columns, also where there are none."""
    return list(zip(*rows, strict=True)) if rows else [[] for _ in range(n)]
