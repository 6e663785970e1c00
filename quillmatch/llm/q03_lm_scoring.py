"""op3: a probabilistic suffix tree's score of every document."""

from pyspark.sql import functions as F

from .common import table
from .suffix_tree import score

NAME = "op3_lm_scoring"
ORACLE = None


def query(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score(table(spark, sf_dir, "documents"), held_out)
