"""op13: whitened embeddings, 16 components."""

from .common import table
from .whitening import whiten

NAME = "op13_whitening"
ORACLE = None


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
