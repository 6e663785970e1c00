"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs whose
possible hits an exact hash join confirms. DataFrame functions only.

The filter is a table of (slot, word): a listed URL sets `BITS` bits of the one 64-bit word in its
slot, so that a probe reads a single word. Words are united by bit_or, which Spark pre-aggregates
before it shuffles. A probe is an equi-join on the slot; only rows whose bits are all set go on to
the exact join on the canonical URL.

Size: `bits_per_url` bits for each listed URL. Up to `max_broadcast_slots` words the filter is
broadcast (16 bytes a row); a longer list uses the same filter by an ordinary equi-join, which
Spark deals out by slot.

Defined results: host and path of a null url, or of one without "://", are empty; such a url fits
no rule and no listed URL and is allowed. An empty or null listed URL lists nothing. Repeated
rows are judged one by one. Other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a listed URL sets in its word.
BITS = 4
BITS_PER_URL = 16
MAX_BROADCAST_SLOTS = 1 << 20

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without "www." and a default port, path without closing slashes, query without
    tracking parameters; no scheme, no fragment. Null where there is no host."""
    rest = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(rest, r"(^|&)utm_[^&]*", ""), "^&", "")
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    full = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(name != "", full)


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Among rules of equal
    length the one with the longer host wins."""
    fitting = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, value) if fitting is None else fitting.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if fitting is None else fitting


def _slot(url: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(slots))


def _word(url: Column) -> Column:
    """A word with the bits of a URL; they come from a hash that is independent of the slot's."""
    seed = F.xxhash64(url, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(seed, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def slots_for(n_urls: int, bits_per_url: int = BITS_PER_URL) -> int:
    return max(1, -(-n_urls * bits_per_url // 64))


def bloom_filter(listed: DataFrame, slots: int) -> DataFrame:
    """listed has one column `url` of canonical URLs."""
    return listed.select(_slot(F.col("url"), slots).alias("_slot"), _word(F.col("url")).alias("_bits")).groupBy("_slot").agg(F.bit_or("_bits").alias("_bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = BITS_PER_URL, max_broadcast_slots: int = MAX_BROADCAST_SLOTS) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, possible (whether the Bloom filter
    passed it on). `listed` has a column `url` of raw URLs whose canonical forms are blocked where
    no rule decides."""
    urls = listed.select(canonical(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    slots = slots_for(urls.count(), bits_per_url)
    words = bloom_filter(urls, slots)
    if slots <= max_broadcast_slots:
        words = F.broadcast(words)

    judged = pages.select("page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("_url"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    # the method is asked only where no rule decides; the other rows take no part in its joins
    undecided = F.col("_rule").isNull() & F.col("_url").isNotNull()
    columns = ("page_id", "host", "path", "_rule", "_listed", "possible")
    no = (F.lit(None).cast("string").alias("_listed"), F.lit(False).alias("possible"))
    decided = judged.where(~undecided).select(*columns[:4], *no)
    asked = judged.where(undecided).withColumn("_at", _slot(F.col("_url"), slots)).withColumn("_word", _word(F.col("_url")))
    words = words.withColumnRenamed("_slot", "_slot_of").withColumnRenamed("_bits", "_bits_of")
    probed = asked.join(words, asked["_at"] == words["_slot_of"], "left").withColumn("possible", F.coalesce(F.col("_bits_of").bitwiseAND(F.col("_word")) == F.col("_word"), F.lit(False)))
    missed = probed.where(~F.col("possible")).select(*columns[:4], *no)

    exact = urls.select(F.col("url").alias("_listed"))
    hits = probed.where("possible")
    hits = hits.join(exact, hits["_url"] == exact["_listed"], "left").select(*columns)
    return decided.unionByName(missed).unionByName(hits).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "possible",
    )
