"""op5: the language of every document."""

from pyspark.sql import functions as F

from .common import table
from .language_id import identify

NAME = "op5_language_id"
ORACLE = None


def query(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return identify(table(spark, sf_dir, "documents"), held_out)
