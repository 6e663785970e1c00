"""op12: how far the sources of each language diverge."""

from .common import table
from .source_divergence import divergence

NAME = "op12_source_divergence"


def query(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS k FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), l AS (SELECT lang, count(*) AS v, sum(k) AS total FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), gt AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source
), p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(gt.total, 0) + 5 * l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (kept.k + 5)) // (l.total + 5 * l.v) AS BIGINT) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
