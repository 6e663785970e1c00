"""The engine's queries over the driver's tables, and the same in SQL.

References are documents and turns of conversations; scoring and single-pass resolution are
registered over items of the benchmark too, those over turns by names that end in `_turns`. All get
ids of fixed width, so that their order as strings is that of the numbers.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions.text import split_name_address
from quillmatch.operators import blocking, correction, metrics, quality, scoring, stats
from quillmatch.operators.block_correction import correct_blocks
from quillmatch.operators.closure import components
from quillmatch.plans import reports
from quillmatch.plans.params import Params
from quillmatch.plans.resolve import clusters_of, one_iteration, resolve
from quillmatch.plans.staging import staged
from quillmatch.sources.readers import parse_lines, resolve_duplicates, spread

P = Params(beta=6, sigma=12, minBlkTokenLen=4, comparator="ScoringMatrixKris")

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d, p: Params = P) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("refID"), F.col("text").alias("body"), F.col("doc_id").alias("ord"))
    return stats.tokenize(spread(rows), p)


def tokenized(spark, d) -> DataFrame:
    """The tokens of all documents, written once: for queries that read them more than once."""
    return staged(documents(spark, d))


def turns(spark, d, p: Params = P) -> DataFrame:
    t = _table(spark, d, "conversations")
    ref = F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    rows = t.select(ref.alias("refID"), F.col("text").alias("body"), (F.col("conv_id") * 10000 + F.col("turn")).alias("ord"))
    return resolve_duplicates(stats.tokenize(rows, p))


def items(spark, d, p: Params = P) -> DataFrame:
    rows = _table(spark, d, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 8, "0").alias("refID"), F.col("text").alias("body"), F.col("item_id").alias("ord"))
    return stats.tokenize(rows, p)


def _joined(tokens="tokens"):
    return F.array_join(tokens, " ").alias("tokens")


# --- SQL that several queries share ------------------------------------------------------------

_UPPER = "upper(replace(coalesce(text, ''), 'ß', 'SS'))"
_SPLIT = rf"list_filter(regexp_split_to_array({_UPPER}, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
_DOCS = rf"docs AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS refID, doc_id AS ord, {_SPLIT} AS tokens FROM documents)"
_TURNS = rf"docs AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS refID, conv_id * 10000 + turn AS ord, {_SPLIT} AS tokens FROM conversations)"
_ITEMS = rf"docs AS (SELECT lpad(CAST(item_id AS VARCHAR), 8, '0') AS refID, item_id AS ord, {_SPLIT} AS tokens FROM benchmark)"
_ROWS = "tok AS (SELECT refID, ord, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token FROM docs)"
_FREQ = "freq AS (SELECT token, count(*) AS n, min(ord * 10000000 + pos) AS first FROM tok GROUP BY token)"
_BT = r"bt AS (SELECT refID, token, count(*) AS m FROM tok JOIN freq USING (token) WHERE n BETWEEN 2 AND 6 AND len(token) >= 4 AND NOT regexp_matches(token, '^\p{Nd}+$') GROUP BY 1, 2)"
# keys of token pairs, spelt out
_KEYS2 = r"""occ AS (SELECT refID, pos, token FROM tok JOIN freq USING (token) WHERE n BETWEEN 2 AND 6 AND len(token) >= 4 AND NOT regexp_matches(token, '^\p{Nd}+$')
), keys AS (SELECT a.refID, least(a.token, b.token) AS t1, greatest(a.token, b.token) AS t2, count(*) AS c FROM occ a JOIN occ b ON a.refID = b.refID AND a.pos < b.pos GROUP BY 1, 2, 3
), pairs AS (
  SELECT DISTINCT a.refID AS refID1, b.refID AS refID2 FROM keys a JOIN keys b ON a.t1 = b.t1 AND a.t2 = b.t2 AND a.refID < b.refID
  UNION SELECT refID, refID FROM keys WHERE c > 1)"""
_CMP = r"""cmp AS (SELECT docs.refID, coalesce(list(tok.token ORDER BY pos) FILTER (WHERE n < 12 AND len(tok.token) >= 4 AND NOT regexp_matches(tok.token, '^\p{Nd}+$')), []) AS tokens
  FROM docs LEFT JOIN tok USING (refID) LEFT JOIN freq USING (token) GROUP BY docs.refID)"""


# the SQL engine's distance counts bytes, so accented capitals stand as one small letter each
def _bytes(token: str) -> str:
    return f"translate({token}, 'ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', 'abcdefghijklmnopqrst')"


def _with(*parts: str, then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {then}"


# --- tokenizers and statistics -------------------------------------------------------------------


@query(_with(_DOCS, then="SELECT refID, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS n FROM docs"))
def tok_splitter(spark, d):
    return documents(spark, d).select("refID", _joined(), F.size("tokens").cast("long").alias("n"))


@query(rf"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace({_UPPER}, ',', ' '), '[\s\x0B]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]+', '', 'g')), lambda x: x <> '') AS t FROM documents)
SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS refID, array_to_string(t, ' ') AS tokens FROM c""")
def tok_compress(spark, d):
    return documents(spark, d, P.with_(tokenizerType="Compress")).select("refID", _joined())


@query(
    rf"""WITH f AS (SELECT doc_id, unnest(range(1, len(fs) + 1)) AS i, unnest(fs) AS field FROM (SELECT doc_id, string_split({_UPPER}, ',') AS fs FROM documents)
), v AS (SELECT doc_id, i, list_transform(list_filter(regexp_split_to_array(field, '[\s\x0B]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS ws FROM f
), w AS (SELECT doc_id, i, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM v
), d AS (SELECT *, regexp_matches(w, '^\p{{Nd}}+$') AS d FROM w
), g AS (SELECT *, CASE WHEN d THEN pos - row_number() OVER (PARTITION BY doc_id, i, d ORDER BY pos) ELSE -pos END AS grp FROM d
), r AS (SELECT doc_id, i, min(pos) AS pos, string_agg(w, '' ORDER BY pos) AS t FROM g GROUP BY doc_id, i, d, grp
), j AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i, pos) AS tokens FROM r GROUP BY doc_id)
SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS refID, coalesce(j.tokens, '') AS tokens FROM documents LEFT JOIN j USING (doc_id)"""
)
def tok_compressnbr(spark, d):
    return documents(spark, d, P.with_(tokenizerType="CompressNbr")).select("refID", _joined())


@query(_with(_DOCS, then="SELECT refID, array_to_string(list_filter(tokens, lambda x, i: list_position(tokens, x) = i), ' ') AS tokens FROM docs"))
def tok_dedup(spark, d):
    return documents(spark, d, P.with_(removeDuplicateTokens=True)).select("refID", _joined())


@query(_with(_DOCS, _ROWS, _FREQ, then="SELECT token, n FROM freq"))
def token_freq(spark, d):
    return stats.token_frequency(documents(spark, d)).select("token", "n")


@query(
    _with(
        _DOCS,
        _ROWS,
        _FREQ,
        r"digits AS (SELECT coalesce(sum(n), 0) AS k FROM freq WHERE regexp_matches(token, '^\p{Nd}+$'))",
        r"o AS (SELECT min(len(token)) AS min_len, max(len(token)) AS max_len, round(avg(len(token)), 4) AS avg_len, round(stddev_samp(len(token)), 4) AS std_len, count(*) AS tokens FROM tok)",
        then="""SELECT (SELECT count(*) FROM docs) AS refs, CAST(any_value(tokens) AS BIGINT) AS tokens, count(*) AS unique_tokens, round(count(*) / any_value(tokens), 4) AS unique_ratio,
        CAST(any_value(k) AS BIGINT) AS numeric_tokens, round(any_value(k) / any_value(tokens), 4) AS numeric_ratio, min(n) AS min_freq, max(n) AS max_freq, round(avg(n), 4) AS avg_freq, round(stddev_pop(n), 4) AS std_freq,
        any_value(min_len) AS min_len, any_value(max_len) AS max_len, any_value(avg_len) AS avg_len, any_value(std_len) AS std_len FROM freq, o, digits""",
    )
)
def token_stats(spark, d):
    return stats.token_statistics(documents(spark, d))


@query(_with(_DOCS, _ROWS, then="SELECT CAST(len(token) AS BIGINT) AS length, count(*) AS n FROM tok GROUP BY 1"))
def token_len_stats(spark, d):
    return stats.token_lengths(stats.token_frequency(documents(spark, d)))


@query(_with(_DOCS, _ROWS, _FREQ, then="SELECT token, n FROM freq ORDER BY n DESC, first LIMIT 10"))
def top10(spark, d):
    return stats.top_tokens(stats.token_frequency(documents(spark, d))).select("token", "n")


@query(_with(_DOCS, _ROWS, _FREQ, then="SELECT token, n FROM freq WHERE n >= 12"))
def stop_words(spark, d):
    return stats.token_frequency(documents(spark, d)).where(F.col("n") >= P.sigma).select("token", "n")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {_SPLIT} AS tokens FROM conversations), p AS (SELECT *, list_position(list_transform(tokens, lambda x: regexp_matches(x, '\p{{Nd}}')), true) AS k FROM t)
SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS refID,
  array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN tokens ELSE tokens[1:k - 1] END, ' ') AS name, array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN [] ELSE tokens[k:] END, ' ') AS address FROM p"""
)
def name_address_split(spark, d):
    name, address = split_name_address(F.col("tokens"))
    return turns(spark, d).select("refID", F.array_join(name, " ").alias("name"), F.array_join(address, " ").alias("address"))


@query(r"""WITH l AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_name || '|' || c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR) END AS v FROM customer)
SELECT CASE WHEN instr(v, '|') = 0 THEN substr(v, 1, len(v) - 1) ELSE substr(v, 1, instr(v, '|') - 1) END AS refID, CASE WHEN instr(v, '|') = 0 THEN v ELSE substr(v, instr(v, '|') + 1) END AS body, instr(v, '|') = 0 AS malformed FROM l""")
def reference_reader(spark, d):
    c = _table(spark, d, "customer")
    line = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return parse_lines(c.select(line.alias("value"), F.col("c_custkey").alias("ord")), "|").drop("ord")


@query(
    _with(
        f"l AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS refID, conv_id * 10000 + turn AS ord, {_SPLIT} AS tokens FROM conversations)",
        then="SELECT refID, array_to_string(arg_max(tokens, ord), ' ') AS tokens, min(ord) AS ord FROM l GROUP BY refID",
    )
)
def duplicate_ids(spark, d):
    """The turns of a conversation as lines of one id: the last one's tokens at the first one's place."""
    t = _table(spark, d, "conversations")
    rows = t.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("refID"), F.col("text").alias("body"), (F.col("conv_id") * 10000 + F.col("turn")).alias("ord"))
    return resolve_duplicates(stats.tokenize(rows, P)).select("refID", _joined(), "ord")


# --- blocking --------------------------------------------------------------------------------------


@query(_with(_DOCS, _ROWS, _FREQ, _BT, then="SELECT refID, token, m FROM bt"))
def blocking_tokens(spark, d):
    refs = tokenized(spark, d)
    return blocking.blocking_tokens(refs, stats.token_frequency(refs), P)


@query(_with(_DOCS, _ROWS, _FREQ, _BT, then="SELECT token, count(*) AS refs FROM bt GROUP BY 1 HAVING count(*) > 1"))
def block_sizes(spark, d):
    refs = tokenized(spark, d)
    return blocking.block_sizes(refs, stats.token_frequency(refs), P)


@query(_with(_DOCS, _ROWS, _FREQ, _BT, then="SELECT DISTINCT a.refID AS refID1, b.refID AS refID2 FROM bt a JOIN bt b ON a.token = b.token AND (a.refID < b.refID OR (a.refID = b.refID AND a.m > 1))"))
def block_pairs_single(spark, d):
    refs = tokenized(spark, d)
    return blocking.candidate_pairs(refs, stats.token_frequency(refs), P.with_(blockByPairs=False))


@query(_with(_TURNS, _ROWS, _FREQ, _KEYS2, then="SELECT refID1, refID2 FROM pairs"))
def block_pairs_double(spark, d):
    refs = turns(spark, d)
    return blocking.candidate_pairs(refs, stats.token_frequency(refs), P)


@query(_with(_DOCS, _ROWS, _FREQ, _BT, then="SELECT a.refID AS refID1, b.refID AS refID2 FROM bt a JOIN bt b ON a.token = b.token AND a.refID < b.refID GROUP BY 1, 2 HAVING sum(least(a.m, b.m)) >= 2 UNION ALL SELECT refID, refID FROM bt GROUP BY 1 HAVING max(m) >= 3 OR (max(m) = 2 AND count(*) >= 2)"))
def block_pairs_documents(spark, d):
    refs = tokenized(spark, d)
    return blocking.candidate_pairs(refs, stats.token_frequency(refs), P)


@query(_with(_DOCS, _ROWS, _FREQ, _CMP, then="SELECT refID, array_to_string(tokens, ' ') AS tokens FROM cmp"))
def comparison_tokens(spark, d):
    refs = tokenized(spark, d)
    return blocking.comparison_tokens(refs, stats.token_frequency(refs), P).select("refID", _joined())


# --- corrections -----------------------------------------------------------------------------------

_WORDS = ("ABEND", "BAUM", "EAU", "THE", "THING")
_WORD_ROWS = ", ".join(f"('{w}')" for w in _WORDS)
_CLEAN = rf"clean AS (SELECT token, n, first FROM freq WHERE len(token) >= 3 AND regexp_matches(token, '^\p{{L}}+$') AND NOT (n <= 3 AND token IN (SELECT * FROM (VALUES {_WORD_ROWS}))))"
_CORR = r"""ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS r, count(*) OVER () AS k FROM clean
), std AS (SELECT token, r, unnest(list_distinct(list_append([token[:i - 1] || token[i + 1:] FOR i IN range(1, len(token) + 1)], token))) AS key FROM ranked WHERE n >= 5 AND r < k
), err AS (SELECT token, unnest(list_distinct(list_append([token[:i - 1] || token[i + 1:] FOR i IN range(1, len(token) + 1)], token))) AS key FROM ranked WHERE n <= 3 AND r > 2
), corr AS (SELECT err.token AS bad, arg_min(std.token, std.r) AS std FROM std JOIN err USING (key) WHERE damerau_levenshtein(translate(std.token, 'ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', 'abcdefghijklmnopqrst'), translate(err.token, 'ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', 'abcdefghijklmnopqrst')) = 1 GROUP BY 1)"""


def _words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _WORDS], "word string")


@query(_with(_DOCS, _ROWS, _FREQ, _CLEAN, then="SELECT token, n FROM clean"))
def word_list_anti(spark, d):
    return correction.clean_tokens(stats.token_frequency(documents(spark, d)), _words(spark), P).select("token", "n")


def _corrections(spark, d, refs) -> DataFrame:
    return correction.corrections(stats.token_frequency(refs), P, _words(spark))


@query(_with(_DOCS, _ROWS, _FREQ, _CLEAN, _CORR, then="SELECT bad, std FROM corr"))
def std_err_corrections(spark, d):
    return _corrections(spark, d, documents(spark, d))


@query(_with(_TURNS, _ROWS, _FREQ, _CLEAN, _CORR, then="SELECT docs.refID, coalesce(array_to_string(list(coalesce(std, token) ORDER BY pos) FILTER (WHERE token IS NOT NULL), ' '), '') AS tokens, count(std) AS n_changed FROM docs LEFT JOIN tok USING (refID) LEFT JOIN corr ON token = bad GROUP BY 1"))
def apply_corrections(spark, d):
    refs = turns(spark, d)
    return correction.apply_corrections(refs, _corrections(spark, d, refs)).select("refID", _joined(), "n_changed")


_VARIANTS = (("THE", "TEH"), ("THE", "HTE"), ("THING", "THIGN"))
_VARIANT_ROWS = ", ".join(f"('{s}', '{v}')" for s, v in _VARIANTS)


@query(_with(_TURNS, _ROWS, _FREQ, _CLEAN, _CORR, f"old(std, variant) AS (VALUES {_VARIANT_ROWS})", then=r"SELECT std, array_to_string(list_sort(list(DISTINCT variant)), ' ') AS variants FROM (SELECT std, variant FROM old UNION SELECT std, bad FROM corr WHERE bad NOT IN (SELECT variant FROM old) AND regexp_matches(std, '^\p{L}+$')) GROUP BY 1"))
def learn_variants(spark, d):
    refs = turns(spark, d)
    found = correction.learned_variants(spark.createDataFrame(_VARIANTS, "std string, variant string"), _corrections(spark, d, refs))
    return found.select("std", F.array_join("variants", " ").alias("variants"))


@query(_with(_TURNS, _ROWS, _FREQ, _CLEAN, _CORR, then="SELECT bad AS old, std AS new, n FROM corr JOIN freq ON token = bad"))
def global_edits(spark, d):
    refs = turns(spark, d)
    return correction.replaced(stats.token_frequency(refs), _corrections(spark, d, refs))


@query(_with(_TURNS, _ROWS, _FREQ, _CLEAN, _CORR, f"known(std, bad) AS (VALUES {_VARIANT_ROWS})", then="SELECT coalesce(k.bad, c.bad) AS bad, coalesce(k.std, c.std) AS std FROM corr c FULL JOIN known k ON c.bad = k.bad"))
def variant_override(spark, d):
    return correction.with_variants(_corrections(spark, d, turns(spark, d)), spark.createDataFrame(_VARIANTS, "std string, variant string"))


_ALIASES = (("BOB", "ROBERT"), ("OF", "VON"), ("THE", "LE"), ("TO", "ZU"))


@query(_with(_TURNS, _ROWS, _FREQ, "a(alias, value) AS (VALUES " + ", ".join(f"('{a}', '{v}')" for a, v in _ALIASES) + ")", then="SELECT token, n, value FROM freq JOIN a ON token = alias"))
def alias_lookup(spark, d):
    freq = stats.token_frequency(turns(spark, d)).select("token", "n")
    aliases = F.broadcast(spark.createDataFrame(_ALIASES, "alias string, value string"))  # a handful of fixed rows
    return freq.join(aliases, F.col("token") == F.col("alias")).drop("alias")


def _corrected(spark, refs):
    freq = staged(stats.token_frequency(refs))
    pairs = staged(blocking.candidate_pairs(refs, freq, P))
    return correct_blocks(refs, freq, pairs, spark.createDataFrame(_ALIASES, "alias string, value string"))


@query()
def block_correction(spark, d):
    return _corrected(spark, staged(turns(spark, d))).refs.select("refID", _joined())


@query()
def block_correction_documents(spark, d):
    return _corrected(spark, tokenized(spark, d)).refs.select("refID", _joined())


@query()
def block_edits(spark, d):
    """How often block correction makes each edit in turns."""
    return _corrected(spark, staged(turns(spark, d))).edits


# --- scoring ---------------------------------------------------------------------------------------

_TURN_PAIRS = (_TURNS, _ROWS, _FREQ, _BT, "pairs AS (SELECT a.refID AS refID1, b.refID AS refID2 FROM bt a JOIN bt b ON a.token = b.token AND a.refID < b.refID GROUP BY 1, 2 HAVING sum(least(a.m, b.m)) >= 2 UNION ALL SELECT refID, refID FROM bt GROUP BY 1 HAVING max(m) >= 3 OR (max(m) = 2 AND count(*) >= 2))", _CMP)
_PAIRS = (_ITEMS, *_TURN_PAIRS[1:])
_LISTS = "lists AS (SELECT refID1, refID2, x.tokens AS a, y.tokens AS b FROM pairs JOIN cmp x ON x.refID = refID1 JOIN cmp y ON y.refID = refID2)"
_SIM = "(CASE WHEN {p} = {q} THEN 1.0::DOUBLE ELSE 1 - damerau_levenshtein(" + _bytes("{p}") + ", " + _bytes("{q}") + ")::DOUBLE / greatest(len({p}), len({q})) END)"
_GREEDY = (
    *_PAIRS,
    _LISTS,
    "short AS (SELECT refID1, refID2, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS a, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS b FROM lists WHERE len(a) > 0 AND len(b) > 0)",
    "ix AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM short), ij AS (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM ix)",
    "sims AS (SELECT refID1, refID2, len(a) AS m, i, j, a[i] AS t1, b[j] AS t2, " + _SIM.format(p="a[i]", q="b[j]") + " AS sim FROM ij)",
    "cells AS (SELECT refID1, refID2, any_value(m) AS m, list({'i': i, 'j': j, 'sim': sim, 'r': []::BIGINT[], 'c': []::BIGINT[], 's': []::DOUBLE[]} ORDER BY sim DESC, i, j) AS l FROM sims GROUP BY 1, 2)",
    "picked AS (SELECT refID1, refID2, m, list_reduce(l, lambda x, y: CASE WHEN list_contains(x.r, y.i) OR list_contains(x.c, y.j) THEN x ELSE {'i': y.i, 'j': y.j, 'sim': y.sim, 'r': list_append(x.r, y.i), 'c': list_append(x.c, y.j), 's': list_append(x.s, y.sim)} END, {'i': 0::BIGINT, 'j': 0::BIGINT, 'sim': 0.0::DOUBLE, 'r': []::BIGINT[], 'c': []::BIGINT[], 's': []::DOUBLE[]}) AS g FROM cells)",
    "steps AS (SELECT refID1, refID2, m, unnest(range(len(g.r))) AS step, unnest(g.r) AS i, unnest(g.c) AS j, unnest(g.s) AS sim FROM picked)",
)
_KRIS = "kris AS (SELECT refID1, refID2, sum(sim * (m - i + 1) / (m * (m + 1) / 2)) AS score FROM steps GROUP BY 1, 2)"


def _scores(spark, d, comparator: str, of=items, **changes) -> DataFrame:
    p = P.with_(comparator=comparator, **changes)
    refs = of(spark, d)
    freq = stats.token_frequency(refs)
    return scoring.score(blocking.candidate_pairs(refs, freq, p), blocking.comparison_tokens(refs, freq, p), p, restricted=False).select("refID1", "refID2", F.round("score", 8).alias("score"))


@query(_with(*_PAIRS, _LISTS, then="SELECT refID1, refID2, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) FOR x IN list_distinct(a)]) / sqrt(len(a)::DOUBLE * len(b)) END, 8) AS score FROM lists"))
def cosine_pairs(spark, d, of=items):
    return _scores(spark, d, "Cosine", of)


@query(_with(*_GREEDY, _KRIS, then="SELECT refID1, refID2, round(coalesce(score, 0), 8) AS score FROM lists LEFT JOIN kris USING (refID1, refID2)"))
def kris_pairs(spark, d, of=items):
    return _scores(spark, d, "ScoringMatrixKris", of)


@query(
    _with(
        *_GREEDY,
        "runs AS (SELECT refID1, refID2, step, avg(sim) OVER (PARTITION BY refID1, refID2 ORDER BY step) AS mean FROM steps)",
        "std AS (SELECT refID1, refID2, coalesce(arg_min(mean, step) FILTER (WHERE mean < 0.5), arg_max(mean, step)) AS score FROM runs GROUP BY 1, 2)",
        then="SELECT refID1, refID2, round(coalesce(score, 0), 8) AS score FROM lists LEFT JOIN std USING (refID1, refID2)",
    )
)
def std_pairs(spark, d, of=items):
    return _scores(spark, d, "ScoringMatrixStd", of)


@query(
    _with(
        *_PAIRS,
        _LISTS,
        "ix AS (SELECT refID1, refID2, b, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS t FROM lists WHERE len(b) > 0)",
        "best AS (SELECT refID1, refID2, i, list_max([" + _SIM.format(p="t", q="q") + " FOR q IN b]) AS s FROM ix)",
        then="SELECT refID1, refID2, round(coalesce(avg(s), 0), 8) AS score FROM lists LEFT JOIN best USING (refID1, refID2) GROUP BY 1, 2",
    )
)
def monge_pairs(spark, d, of=items):
    return _scores(spark, d, "MongeElkan", of)


@query(
    _with(
        *_GREEDY,
        then="SELECT refID1, refID2, CAST(step AS INTEGER) AS step, a[i] AS token1, b[j] AS token2, round(sim, 8) AS sim, round((m - i + 1) / (m * (m + 1) / 2), 8) AS weight, round(sim * (m - i + 1) / (m * (m + 1) / 2), 8) AS weighted_sim, CAST(i - 1 AS INTEGER) AS row_index, CAST(j - 1 AS INTEGER) AS col_index FROM steps JOIN short USING (refID1, refID2) WHERE sim >= 0.01",
    )
)
def token_match_trace(spark, d, of=items):
    refs = of(spark, d)
    freq = stats.token_frequency(refs)
    rows = reports.token_matches(blocking.candidate_pairs(refs, freq, P), refs, freq, P, restricted=False)
    return rows.select("refID1", "refID2", "step", "token1", "token2", *(F.round(c, 8).alias(c) for c in ("sim", "weight", "weighted_sim")), "row_index", "col_index")


# --- closure, quality, metrics -----------------------------------------------------------------------

_LINKS = "links AS (SELECT refID1, refID2, score FROM kris WHERE score >= 0.5)"
_CLUSTERS = """e AS (SELECT refID1 AS a, refID2 AS b FROM links UNION SELECT refID2, refID1 FROM links),
reach AS (SELECT a, a AS c FROM e UNION SELECT e.a, reach.c FROM e JOIN reach ON e.b = reach.a),
clusters AS (SELECT min(c) AS clusterID, a AS refID FROM reach GROUP BY a)"""


@query("""WITH RECURSIVE e AS (SELECT 'C' || o_custkey AS a, 'O' || o_orderkey AS b FROM orders UNION SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders),
r AS (SELECT a, a AS c FROM e UNION SELECT e.a, r.c FROM e JOIN r ON e.b = r.a) SELECT a AS node, min(c) AS component FROM r GROUP BY 1""")
def closure(spark, d):
    o = _table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("O"), "o_orderkey").alias("b"))
    return components(o)


@query(_with(*_GREEDY, _KRIS, _LINKS, then="SELECT refID1, refID2, round(score, 8) AS score FROM links"))
def er_one_iteration(spark, d, of=items):
    refs = of(spark, d)
    return one_iteration(refs, stats.token_frequency(refs), P, restricted=False).select("refID1", "refID2", F.round("score", 8).alias("score"))


@query(_with(*_GREEDY, _KRIS, _LINKS, _CLUSTERS, then="SELECT clusterID, refID FROM clusters", recursive=True))
def er_clusters(spark, d, of=items):
    refs = of(spark, d)
    return clusters_of(staged(one_iteration(refs, stats.token_frequency(refs), P, restricted=False)))


@query()
def er_full(spark, d):
    return reports.link_index(resolve(turns(spark, d), P.with_(runGlobalCorrection=True), words=_words(spark)).link)


def _talks(spark, d) -> DataFrame:
    """Each conversation as a cluster named by its first turn."""
    refs = turns(spark, d)
    first = refs.groupBy(F.substring("refID", 1, 8).alias("k")).agg(F.min("refID").alias("clusterID"))
    return refs.join(first, F.substring("refID", 1, 8) == F.col("k")).select("clusterID", "refID")


_TALKS = "talks AS (SELECT refID, min(refID) OVER (PARTITION BY substr(refID, 1, 8)) AS clusterID FROM docs)"
_HALVES = r"""digit AS (SELECT refID, tokens, coalesce(list_position(list_transform(tokens, lambda x: regexp_matches(x, '\p{Nd}')), true), 0) AS k FROM docs
), halves AS (SELECT refID, CASE WHEN k = 0 THEN tokens ELSE tokens[1:k - 1] END AS name, CASE WHEN k = 0 THEN [] ELSE tokens[k:] END AS address FROM digit)"""
_QUALITY = """sized AS (SELECT clusterID, count(*) AS size FROM talks GROUP BY 1
), occ AS (SELECT clusterID, refID, h, unnest(CASE h WHEN 0 THEN name ELSE address END) AS token FROM talks JOIN halves USING (refID), (VALUES (0), (1)) v(h)
), lay AS (SELECT *, row_number() OVER (PARTITION BY clusterID, refID, h, token) AS layer FROM occ
), grp AS (SELECT clusterID, h, token, layer, count(*) AS c FROM lay GROUP BY ALL
), ent AS (SELECT clusterID, h, sum(c) AS t, sum(-(c / size) * log2(c / size)) AS e, any_value(size) AS n FROM grp JOIN sized USING (clusterID) WHERE size > 1 GROUP BY 1, 2
), q AS (SELECT clusterID, max(CASE WHEN h = 0 THEN 1 - e / (t * log2(n) / n) END) AS name, max(CASE WHEN h = 1 THEN 1 - e / (t * log2(n) / n) END) AS address FROM ent GROUP BY 1
), quality AS (SELECT clusterID, size, coalesce(0.76 * name + 0.24 * address, name, address, 1.0) AS quality FROM sized LEFT JOIN q USING (clusterID))"""


@query(_with(_TURNS, _TALKS, _HALVES, _QUALITY, then="SELECT clusterID, size, round(quality, 4) AS quality FROM quality"))
def entropy_quality(spark, d):
    return quality.entropy_quality(_talks(spark, d), turns(spark, d)).select("clusterID", "size", F.round("quality", 4).alias("quality"))


@query(_with(_TURNS, _TALKS, _HALVES, _QUALITY, then="SELECT count(*) AS clusters, CAST(sum(size) AS BIGINT) AS refs, count(*) FILTER (WHERE size > 1) AS several, count(*) FILTER (WHERE quality >= 0.1) AS good_clusters, CAST(coalesce(sum(size) FILTER (WHERE quality >= 0.1), 0) AS BIGINT) AS good_refs FROM quality"))
def iteration_counters(spark, d):
    return metrics.iteration_counters(quality.entropy_quality(_talks(spark, d), turns(spark, d)), 0.1)


def _linked_documents(spark, d) -> DataFrame:
    """Documents linked by source and length, those of two sources left open."""
    t = _table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("refID"), "source", "n_chars")
    named = t.groupBy("source", "n_chars").agg(F.min("refID").alias("c"))
    return t.join(named, ["source", "n_chars"]).select("refID", F.when(~F.col("source").isin("src1", "src2"), F.col("c")).alias("clusterID"))


def _truth(spark, d) -> DataFrame:
    """Equal texts are one truth; every seventh document has none."""
    t = _table(spark, d, "documents").where("doc_id % 7 <> 0")
    return t.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("refID"), F.md5("text").alias("truthID"))


_LINKED = "link AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS refID, CASE WHEN source NOT IN ('src1', 'src2') THEN min(lpad(CAST(doc_id AS VARCHAR), 8, '0')) OVER (PARTITION BY source, n_chars) END AS clusterID FROM documents)"
_TRUTH = "truth AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS refID, md5(text) AS truthID FROM documents WHERE doc_id % 7 <> 0)"
_RATIOS = "CASE WHEN {f} = 0 THEN 1.0 ELSE round(true_pairs / {f}, 4) END AS precision, CASE WHEN expected_pairs = 0 THEN 1.0 ELSE round(true_pairs / expected_pairs, 4) END AS recall"
_FMEAN = "SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 4) END AS f_measure FROM r"


@query(_with(_LINKED, then="SELECT size, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS refs FROM (SELECT count(*) AS size FROM link GROUP BY coalesce(clusterID, '')) GROUP BY 1"))
def cluster_profile(spark, d):
    return metrics.cluster_profile(_linked_documents(spark, d))


@query(_with(_LINKED, "s AS (SELECT count(*) AS size FROM link GROUP BY coalesce(clusterID, ''))", then="SELECT size, count(*) AS clusters, CAST(coalesce(sum(size), 0) AS BIGINT) AS refs FROM s GROUP BY size UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(size), 0) AS BIGINT) FROM s"))
def cluster_profile_total(spark, d):
    return metrics.profile_with_total(_linked_documents(spark, d))


_SETS = " UNION ALL ".join(
    f"SELECT '{name}' AS by, count(*) AS groups, CAST(sum(n) AS BIGINT) AS refs, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM b GROUP BY {keys})"
    for name, keys in (("cluster", "c"), ("truth", "t"), ("both", "c, t"))
)


@query(_with(_LINKED, _TRUTH, "b AS (SELECT coalesce(clusterID, '') AS c, coalesce(truthID, 'x') AS t FROM link LEFT JOIN truth USING (refID))", then=_SETS))
def pair_sets(spark, d):
    return metrics.pair_sets(_linked_documents(spark, d), _truth(spark, d))


@query(
    _with(
        _LINKED,
        _TRUTH,
        "b AS (SELECT coalesce(clusterID, '') AS c, coalesce(truthID, 'x') AS t FROM link LEFT JOIN truth USING (refID))",
        "k AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY c, t)) AS true_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY t)) AS expected_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY c)) AS linked_pairs)",
        "r AS (SELECT *, " + _RATIOS.format(f="linked_pairs") + " FROM k)",
        then=_FMEAN,
    )
)
def er_metrics(spark, d):
    return metrics.er_metrics(_linked_documents(spark, d), _truth(spark, d))


@query(
    _with(
        _DOCS,
        _ROWS,
        _FREQ,
        _BT,
        _TRUTH,
        "pairs AS (SELECT DISTINCT a.refID AS refID1, b.refID AS refID2 FROM bt a JOIN bt b ON a.token = b.token AND (a.refID < b.refID OR (a.refID = b.refID AND a.m > 1)))",
        "k AS (SELECT count(*) FILTER (WHERE a.truthID = b.truthID) AS true_pairs, (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM truth GROUP BY truthID)) AS expected_pairs, count(*) AS candidate_pairs FROM pairs LEFT JOIN truth a ON a.refID = refID1 LEFT JOIN truth b ON b.refID = refID2)",
        "r AS (SELECT *, " + _RATIOS.format(f="candidate_pairs") + " FROM k)",
        then=_FMEAN,
    )
)
def blocking_metrics(spark, d):
    refs = tokenized(spark, d)
    pairs = blocking.candidate_pairs(refs, stats.token_frequency(refs), P.with_(blockByPairs=False))
    return metrics.blocking_metrics(pairs, refs, _truth(spark, d))


# --- captures and reports ----------------------------------------------------------------------------


@query(_with(_DOCS, _LINKED, then="SELECT refID, coalesce(clusterID, refID) AS clusterID, array_to_string(tokens, ' ') AS tokens FROM link JOIN docs USING (refID)"))
def link_index(spark, d):
    return reports.link_index(_linked_documents(spark, d), documents(spark, d))


@query(_with(_DOCS, then="SELECT refID, array_to_string(tokens, ', ') AS tokens FROM docs"))
def ref_capture(spark, d):
    return reports.ref_capture(documents(spark, d))


@query(_with(*_TURN_PAIRS[:-1], "truth AS (SELECT refID, substr(refID, 1, 8) AS truthID FROM docs WHERE ord % 3 <> 0)", then="SELECT refID1, refID2, array_to_string(x.tokens, ', ') AS tokens1, array_to_string(y.tokens, ', ') AS tokens2, CAST(coalesce(p.truthID = q.truthID, false) AS INTEGER) AS truth FROM pairs JOIN docs x ON x.refID = refID1 JOIN docs y ON y.refID = refID2 LEFT JOIN truth p ON p.refID = refID1 LEFT JOIN truth q ON q.refID = refID2"))
def truth_capture(spark, d):
    refs = turns(spark, d)
    truth = refs.where("ord % 3 <> 0").select("refID", F.substring("refID", 1, 8).alias("truthID"))
    return reports.pair_capture(blocking.candidate_pairs(refs, stats.token_frequency(refs), P), refs, truth)


@query(_with(_TURNS, _ROWS, _FREQ, then="SELECT token, n FROM freq"))
def token_capture(spark, d):
    return reports.token_capture(stats.token_frequency(turns(spark, d)))


_COSINE = "scored AS (SELECT refID1, refID2, a, b, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) FOR x IN list_distinct(a)]) / sqrt(len(a)::DOUBLE * len(b)) END AS score FROM lists)"
_HALF_TRUTH = "truth AS (SELECT refID, substr(refID, 1, 8) AS truthID FROM docs WHERE ord % 3 <> 0)"
_TRUTHS = "CAST(coalesce(p.truthID = q.truthID, false) AS INTEGER) AS truth"


def _half_truth(refs: DataFrame) -> DataFrame:
    return refs.where("ord % 3 <> 0").select("refID", F.substring("refID", 1, 8).alias("truthID"))


@query(_with(*_TURN_PAIRS, _LISTS, _COSINE, _HALF_TRUTH, then=f"SELECT refID1, refID2, array_to_string(x.tokens, ', ') AS tokens1, array_to_string(y.tokens, ', ') AS tokens2, {_TRUTHS} FROM scored JOIN docs x ON x.refID = refID1 JOIN docs y ON y.refID = refID2 LEFT JOIN truth p ON p.refID = refID1 LEFT JOIN truth q ON q.refID = refID2 WHERE score >= 0.5"))
def linked_pair_capture(spark, d):
    """Pairs that one round links by cosine, with their tokens and truth."""
    refs = turns(spark, d)
    links = one_iteration(refs, stats.token_frequency(refs), P.with_(comparator="Cosine"), restricted=False)
    return reports.pair_capture(links.select("refID1", "refID2"), refs, _half_truth(refs))


@query(_with(*_TURN_PAIRS, _LISTS, _COSINE, _HALF_TRUTH, then=f"SELECT refID1, refID2, array_to_string(a, ', ') AS tokens1, array_to_string(b, ', ') AS tokens2, round(score, 8) AS similarity, 0.5::DOUBLE AS mu, {_TRUTHS} FROM scored LEFT JOIN truth p ON p.refID = refID1 LEFT JOIN truth q ON q.refID = refID2"))
def pair_comparison_cosine(spark, d):
    """The comparison of all candidate pairs by cosine, with truth."""
    refs = turns(spark, d)
    freq = stats.token_frequency(refs)
    p = P.with_(comparator="Cosine")
    rows = reports.pair_comparison(blocking.candidate_pairs(refs, freq, p), refs, freq, p, _half_truth(refs))
    return rows.withColumn("similarity", F.round("similarity", 8))


@query(_with(_TURNS, _TALKS, "truth AS (SELECT refID, CAST(len(tokens) % 2 AS VARCHAR) AS truthID FROM docs WHERE ord % 3 <> 0)", "named AS (SELECT clusterID, coalesce(max(truthID) FILTER (WHERE refID = clusterID), arg_min(truthID, refID) FILTER (WHERE truthID IS NOT NULL)) AS t FROM talks LEFT JOIN truth USING (refID) GROUP BY 1)", then="SELECT clusterID, refID, array_to_string(tokens, ', ') AS tokens, CAST(coalesce(truthID = t, false) AS INTEGER) AS truth FROM talks JOIN docs USING (refID) JOIN named USING (clusterID) LEFT JOIN truth USING (refID)"))
def cluster_capture(spark, d):
    refs = turns(spark, d)
    truth = refs.where("ord % 3 <> 0").select("refID", (F.size("tokens") % 2).cast("string").alias("truthID"))
    return reports.cluster_capture(_talks(spark, d), refs, truth)


@query(_with(_TURNS, _TALKS, _HALVES, "rec AS (SELECT clusterID, array_to_string(name, ' ') AS name, array_to_string(address, ' ') AS address, string_agg(DISTINCT refID, ', ' ORDER BY refID) AS refIDs FROM talks JOIN halves USING (refID) GROUP BY 1, 2, 3)", then="SELECT clusterID, CAST(count(*) AS BIGINT) AS n_records, string_agg(refIDs || ':' || name || ':' || address, ';' ORDER BY name, address) AS records FROM rec GROUP BY 1"))
def cluster_json(spark, d):
    rows = reports.cluster_json(_talks(spark, d), turns(spark, d))
    return rows.select("clusterID", F.size("records").cast("long").alias("n_records"), F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["refIDs"], r["name"], r["address"])), ";").alias("records"))


@query()
def pair_comparison(spark, d):
    refs = turns(spark, d)
    freq = stats.token_frequency(refs)
    return reports.pair_comparison(blocking.candidate_pairs(refs, freq, P), refs, freq, P)


@query()
def report_row(spark, d):
    result = resolve(turns(spark, d), P.with_(inputFileName="conversations"))
    truth = result.refs.select("refID", F.element_at("tokens", 1).alias("truthID"))
    return reports.report_row(result, metrics.er_metrics(result.link, truth))


@query()
def run_log(spark, d):
    return reports.run_log(resolve(turns(spark, d), P))


# --- scoring and resolution over all turns -----------------------------------------------------------


def _over_turns(f) -> None:
    """The query also over turns. The SQL of greedy and best matches takes minutes on them, so the
    cosine alone has one; the tests hold the others to it on a small table."""
    QUERIES[f"{f.__name__}_turns"] = partial(f, of=turns)


def turns_sql(name: str) -> str:
    """A query's SQL with turns as the references."""
    return ORACLES[name].replace(_ITEMS, _TURNS)


for _f in (cosine_pairs, kris_pairs, std_pairs, monge_pairs, token_match_trace, er_one_iteration, er_clusters):
    _over_turns(_f)
ORACLES["cosine_pairs_turns"] = turns_sql("cosine_pairs")
