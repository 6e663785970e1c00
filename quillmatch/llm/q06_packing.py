"""op6: all documents packed into sequences of 4096 tokens."""

import public_tokenizers

from .common import table
from .packing import pack

NAME = "op6_packing"
ORACLE = None


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
