"""op2: toxicity of every document."""

from pyspark.sql import functions as F

from .common import table
from .toxicity import score

NAME = "op2_toxicity"
ORACLE = None


def query(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
