"""A training-data pipeline over documents: each stage calls one operator on all that is left.

Every stage but the last returns the columns of documents. What a stage keeps is written by run()
in the shared folder before the next stage reads it, as a driver of the stages would do.

Defined results, of each stage:
* language: a null text, an empty one, or one without a letter has no language and goes; a null
  lang is not learned from; where nothing can be learned, all go.
* near_dedup: a null text, one without words, and a null doc_id are alike to nothing and stay; rows
  of one doc_id are one document, of which all rows stay or go.
* substring_dedup: a null text stays null; of a passage the first place by doc_id stays (a null
  doc_id comes first); a document of which nothing is left goes; n_chars follows a text that
  changed, else it stays as it was, null too.
* decontamination: a null or empty text holds no passage and stays; an empty benchmark removes none.
* packing: a null text is empty, its closing id is packed.
Repeated rows are judged one by one but for what is said above; an empty table gives an empty one.
Columns beside doc_id, text, lang and n_chars are carried on unread, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillmatch.llm.chosen_path import near_duplicates
from quillmatch.llm.common import table
from quillmatch.llm.decontamination import decontaminate
from quillmatch.llm.language_id import identify
from quillmatch.llm.packing import pack
from quillmatch.llm.sentence_spans import dedup_spans
from quillmatch.plans.staging import staged

#: Documents of a lower score than this have no known language.
LEAST_LANGUAGE_SCORE = 0.1
#: Near-duplicates: words of a shingle, and percent of shingles in common.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _named(docs):
    """docs with the columns that no operator reads named by number, and a function that gives all
    columns their names again."""
    names = {c: c if c in ("doc_id", "text", "lang", "n_chars") else f"own_{i}" for i, c in enumerate(docs.columns)}

    def back(rows):
        return rows.select(*(F.col(f"`{new}`").alias(c) for c, new in names.items()))

    return docs.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items())), back


def language(spark, docs, sf_dir):
    """Documents whose language is known; lang stays what the source says."""
    docs, back = _named(docs)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    judged = identify(docs, held_out, carry=tuple(docs.columns))
    return back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates, that of the smallest id."""
    gone = near_duplicates(docs, k=SHINGLE_WORDS, percent=SIMILARITY).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def substring_dedup(spark, docs, sf_dir):
    """Repeated sentence spans are taken out; a document of which nothing is left goes. n_chars
    follows the text."""
    docs, back = _named(docs)
    rows = dedup_spans(docs)
    rows = rows.where((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(rows)


def decontamination(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    docs, back = _named(docs)
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return back(judged.where(~F.col("contaminated")))


def packing(spark, docs, sf_dir):
    """The pieces of all documents in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
