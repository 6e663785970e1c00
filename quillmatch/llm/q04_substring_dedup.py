"""op4: repeated sentence spans taken out of every document."""

from .common import table
from .sentence_spans import dedup_spans

NAME = "op4_substring_dedup"
ORACLE = None


def query(spark, sf_dir):
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
