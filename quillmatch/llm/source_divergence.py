"""How far the vocabularies of sources diverge, language by language.

Counting and pair sums run in DuckDB inside tasks, over hash shards of (lang, term); Spark shuffles
the shards and merges their sums and rankings.
1. Each task over documents counts its texts' terms in SQL, a slice at a time, and combines what it
   counted before it sends it on. A term's rows go to one shard: a row at most for each source and
   task or part of one.
2. A shard gets its rows sorted by (lang, term) and sums them by whole terms, `CHUNK` rows or so at
   once, so that its memory doesn't grow with the shard. Terms of fewer than `LEAST_DOCS` documents
   of the language go.
3. Spark sums N of each (lang, source) and V of each lang. Every shard of the kept terms gets the
   groups of all languages (as many rows as there are sources and languages, far fewer than the
   pairs of sources that it sums), makes shares, and adds up |p - q| for each two sources. A term
   that both lack counts through its languages' V alone, so a shard's work follows the occurrences
   it holds, times sources. It ranks its terms of each group as far as `TOP`.
4. Spark adds the shards' pair sums and ranks pairs and terms.

All arithmetic is exact: products in 128-bit integers.

Defined results: a null text, lang or source is ''; each row of documents is a document, repeated
ones and those of null or equal ids too; a group without terms is kept, and so is one of a language
that keeps no term (all its pair values are 0); a source that is alone in its language has no rows
in part `pair`; equal values rank by the item's bytes; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.plans.staging import staged

from .common import arrow_schema, bounded_batches, slices

LEAST_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Rows of counts that a task combines, and that a shard sums, at once.
CHUNK = 400_000

#: Letters a-z, A-Z lower-cased, and the bytes of non-ASCII characters make terms; all else parts them.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, term string, source string, n long, docs long"
_KEPT = "lang string, term string, source string, n long, first long"
_PARTS = "lang string, source string, part string, item string, value long"


def _database() -> duckdb.DuckDBPyConnection:
    """A database in the memory of a task; it writes no files."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})


def _rows(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema):
    """The rows of a query as Arrow batches of this schema."""
    found = con.sql(sql).to_arrow_table()
    return found.select(schema.names).cast(schema).to_batches(max_chunksize=50_000)


def _number(con: duckdb.DuckDBPyConnection, sql: str) -> int:
    return con.sql(sql).fetchall()[0][0]


def _spaced(text: pa.Array) -> pa.Array:
    """Texts with their terms parted by spaces, made over the column's buffer in one go."""
    text = text.cast(pa.string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[text.offset : text.offset + len(text) + 1]
    raw = data.to_pybytes()[at[0] : at[-1]].translate(_TERMS) if data is not None else b""
    return pa.StringArray.from_buffers(len(text), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(raw))


def term_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lang, term, source, n, docs: how often and in how many documents, by parts that remain to be
    summed."""
    bounded_batches(docs.sparkSession)
    schema = arrow_schema(_COUNTS)

    def run(it):
        con = _database()
        con.execute("CREATE TABLE acc (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
        held, room = 0, chunk
        for batch in slices(it, 2_000_000):
            part = pa.table({"r": pa.array(np.arange(batch.num_rows)), "lang": batch.column(1), "source": batch.column(2), "text": _spaced(batch.column(0))})
            con.register("part", part)
            con.execute("""INSERT INTO acc SELECT lang, term, source, sum(k), count(*) FROM
                (SELECT r, term, count(*) AS k FROM (SELECT r, unnest(string_split(text, ' ')) AS term FROM part) WHERE term <> '' GROUP BY r, term) JOIN part USING (r) GROUP BY lang, term, source""")
            con.unregister("part")
            held = _number(con, "SELECT count(*) FROM acc")
            if held > room:
                con.execute("CREATE OR REPLACE TABLE acc AS SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM acc GROUP BY lang, term, source")
                held = _number(con, "SELECT count(*) FROM acc")
                room = held + chunk
                if held > 2 * chunk:
                    yield from _rows(con, "SELECT * FROM acc", schema)
                    con.execute("DELETE FROM acc")
                    room = chunk
        yield from _rows(con, "SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM acc GROUP BY lang, term, source", schema)

    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*filled).mapInArrow(run, _COUNTS)


def _by_terms(con, it, table: str, chunk: int, combine: str | None = None):
    """Loads batches of rows sorted by (lang, term) into a table and stops, with its number of rows,
    wherever it holds about `chunk` rows of whole terms; what follows the last whole term waits. A
    term of more rows is combined on the way, where `combine` says how."""
    held, room = 0, chunk
    for batch in it:
        if not batch.num_rows:
            continue
        con.register("batch", pa.table(batch))
        con.execute(f"INSERT INTO {table} SELECT * FROM batch")
        con.unregister("batch")
        held += batch.num_rows
        if held > room:
            last = con.sql(f"SELECT lang, term FROM {table} ORDER BY lang DESC, term DESC LIMIT 1").to_arrow_table()
            con.register("last", last)
            con.execute(f"CREATE OR REPLACE TABLE waits AS SELECT t.* FROM {table} t JOIN last USING (lang, term)")
            con.execute(f"DELETE FROM {table} t USING last WHERE t.lang = last.lang AND t.term = last.term")
            con.unregister("last")
            yield
            con.execute(f"DELETE FROM {table}")
            con.execute(f"INSERT INTO {table} {combine or 'SELECT * FROM waits'}")
            held = _number(con, f"SELECT count(*) FROM {table}")
            room = held + chunk
    yield


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK) -> DataFrame:
    """lang, term, source, n, first: the counts of terms in enough documents of their language; first
    is 1 in one row of each (lang, term), else 0."""
    schema = arrow_schema(_KEPT)
    sums = "SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM {} GROUP BY lang, term, source"
    keep = f"""WITH t AS ({sums.format("acc")}), k AS (SELECT lang, term, min(source) AS low FROM t GROUP BY lang, term HAVING sum(docs) >= {int(least_docs)})
        SELECT lang, term, source, n, CASE WHEN source = low THEN 1 ELSE 0 END AS first FROM t JOIN k USING (lang, term)"""

    def run(it):
        con = _database()
        con.execute("CREATE TABLE acc (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
        for _ in _by_terms(con, it, "acc", chunk, sums.format("waits")):
            yield from _rows(con, keep, schema)

    return counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _KEPT)


def _share(n: str, total: str, v: str) -> str:
    return f"CAST(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * {v}::HUGEINT) AS BIGINT)"


# the chunk's shares: p of the group, q of the language, b of a term that the group lacks
_SHARES = f"""CREATE OR REPLACE TABLE shares AS WITH l AS (SELECT lang, term, sum(n) AS k FROM own GROUP BY lang, term)
    SELECT o.lang, o.term, o.source, {_share("o.n", "g.total", "g.v")} AS p, {_share("l.k", "g.lang_total", "g.v")} AS q, g.base AS b
    FROM own o JOIN l USING (lang, term) JOIN groups g USING (lang, source)"""
# what a term adds for two sources to |base of one - base of the other|: where one has it, and where both have it
_PAIRS = """INSERT INTO pairs SELECT lang, least(source, other), greatest(source, other), CAST(sum(x) AS BIGINT) FROM (
    SELECT s.lang, s.source, g.source AS other, sum(abs(s.p - g.base) - abs(s.b - g.base)) AS x FROM shares s JOIN groups g ON s.lang = g.lang AND s.source <> g.source GROUP BY ALL
    UNION ALL SELECT a.lang, a.source, z.source, sum(abs(a.p - z.p) - abs(a.p - z.b) - abs(z.p - a.b) + abs(a.b - z.b)) FROM shares a JOIN shares z ON a.lang = z.lang AND a.term = z.term AND a.source < z.source GROUP BY ALL
) GROUP BY ALL"""


def _best(source: str, top: int) -> str:
    return f"""SELECT lang, source, term, value FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS r FROM ({source})) WHERE r <= {int(top)}"""


def shard_sums(kept: DataFrame, groups: DataFrame, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """Parts of the result: pair sums that remain to be added up, source < item, and each shard's best
    terms of each group. groups: lang, source, total, lang_total, v."""
    spark = kept.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "lang", "term", "source", "n", *(F.lit(None).cast("long").alias(c) for c in ("total", "lang_total", "v")))
    every = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "lang", F.lit("").alias("term"), "source", F.lit(0).cast("long").alias("n"), "total", "lang_total", "v")
    rows = own.unionByName(every).repartition(shards, "shard").sortWithinPartitions("kind", "lang", "term")
    schema = arrow_schema(_PARTS)

    def run(it):
        con = _database()
        con.execute("CREATE TABLE read (lang VARCHAR, source VARCHAR, total BIGINT, lang_total BIGINT, v BIGINT)")
        con.execute("CREATE TABLE own (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT)")
        con.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, other VARCHAR, value BIGINT)")
        con.execute("CREATE TABLE best (lang VARCHAR, source VARCHAR, term VARCHAR, value BIGINT)")
        mine = [False]  # whether this task has shard 0, which gives what pairs have in common

        def terms():
            """Loads the groups, which come first, and passes the terms on."""
            made = False
            for batch in it:
                t = pa.table(batch)
                con.register("batch", t)
                if not made:
                    mine[0] |= bool(_number(con, "SELECT count(*) FROM batch WHERE shard = 0"))
                    con.execute("INSERT INTO read SELECT DISTINCT lang, source, total, lang_total, v FROM batch WHERE kind = 0")
                rest = con.sql("SELECT lang, term, source, n FROM batch WHERE kind = 1").to_arrow_table()
                con.unregister("batch")
                if rest.num_rows:
                    if not made:
                        finish()
                        made = True
                    yield from rest.to_batches()
            if not made:
                finish()

        def finish():
            con.execute(f"CREATE TABLE groups AS SELECT *, CASE WHEN v > 0 THEN {_share('0', 'total', 'v')} ELSE 0 END AS base FROM (SELECT DISTINCT * FROM read)")

        for _ in _by_terms(con, terms(), "own", chunk):
            con.execute(_SHARES)
            con.execute(_PAIRS)
            con.execute("CREATE OR REPLACE TABLE pairs AS SELECT lang, source, other, sum(value)::BIGINT AS value FROM pairs GROUP BY lang, source, other")
            con.execute(f"CREATE OR REPLACE TABLE best AS {_best('SELECT lang, source, term, p - q AS value FROM shares WHERE p > q UNION ALL SELECT lang, source, term, value FROM best', top)}")
        if mine[0]:
            con.execute("INSERT INTO pairs SELECT a.lang, a.source, z.source, a.v * abs(a.base - z.base) FROM groups a JOIN groups z ON a.lang = z.lang AND a.source < z.source")
        yield from _rows(con, "SELECT lang, source, 'pair' AS part, other AS item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, value FROM best", schema)

    kinds = ", ".join(["shard int", "kind int", "lang string", "term string", "source string", "n long", "total long", "lang_total long", "v long"])
    assert rows.columns == [k.split()[0] for k in kinds.split(", ")]
    return rows.mapInArrow(run, _PARTS)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = staged(kept_terms(term_counts(docs, chunk), least_docs, chunk))
    found = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("n").alias("total"))
    langs = kept.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("lang_total"), F.sum("first").alias("v"))
    groups = found.join(totals, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").join(langs, F.col("lang") == F.col("_lang"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v")]
    parts = staged(shard_sums(kept, staged(groups.select("lang", "source", *zero)), top, chunk))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(own)).unionByName(terms)
