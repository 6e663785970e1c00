"""op9: the verdict on every page's url. Listed are the URLs of pages whose id is divisible by 100."""

from pyspark.sql import functions as F

from .common import table
from .url_filter import filter_urls

NAME = "op9_url_filter"


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.pmod("page_id", F.lit(100)) == 0).select("url")
    return filter_urls(pages, listed).drop("possible")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM p
), t AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') AS name FROM s
), k AS (
  SELECT *, CASE WHEN name <> '' THEN name || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canon FROM t
), listed AS (SELECT DISTINCT canon AS listed FROM k WHERE page_id % 100 = 0 AND canon IS NOT NULL
), ruled AS (
  SELECT k.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM k
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed ON canon = listed
"""
