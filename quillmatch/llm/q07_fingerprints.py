"""op7: bottom-k fingerprints of every document and its edited text."""

from .bottom_k import fingerprints
from .common import table

NAME = "op7_fingerprints"
ORACLE = None


def query(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
