"""op8: tokens of every document before and after three edits, at a third, the middle and the end."""

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .token_counts import count_with

NAME = "op8_token_counts"
ORACLE = None


def edits():
    """Seven code points are removed at a third, a word is inserted in the middle, the end grows."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")

    def edit(at, removed, inserted):
        return F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))

    return F.array(edit(F.floor(n / 3), 7, ""), edit(F.floor(n / 2), 0, " edit2 "), edit(n, 5, "'ll end."))


def query(spark, sf_dir):
    return count_with(table(spark, sf_dir, "documents"), edits(), public_tokenizers.path("byte_bpe_50k.json"))
