"""The pipeline's stages on a small folder of tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, prose, vocabulary


def test_stages(spark, tmp_path):
    rnd = random.Random(20)
    words = vocabulary(300)
    passage, item = prose(rnd, words, 70), prose(rnd, words, 30)
    texts = [prose(rnd, words, rnd.randint(40, 120)) for _ in range(30)]
    texts += [texts[4], texts[5] + " more", texts[6] + "\n" + passage, texts[7] + "\n" + passage, texts[8] + " " + item, None, "12 34"]
    texts[6], texts[7], texts[8] = (prose(rnd, words, 60) for _ in range(3))
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{n}"))
        docs = spark.read.parquet(str(tmp_path / f"out{n}"))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(range(37)) - set(left[0]) == {35, 36}
    assert set(left[0]) - set(left[1]) == {30, 31}
    assert passage.split(".")[1] in left[2][32] and passage.split(".")[1] not in left[2][33]
    assert all(left[2][i] == left[1][i] for i in left[2] if i != 33)
    assert set(left[2]) - set(left[3]) == {34}
    assert {r["doc_id"] for r in docs.collect()} == set(left[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Columns that are named as what the operators return, or use inside, come out as they were;
    nulls, empty texts, repeated rows and an empty table go through every stage."""
    rnd = random.Random(34)
    words = vocabulary(200)
    texts = [prose(rnd, words, 60) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(20, None, "en", None, None), (21, "", None, "s", 0), (None, texts[3] + " tail words here", "de", "s", 1), (5, texts[5], "en", "s", len(texts[5])), (22, "x " * 200_000, "en", "s", 400_000)]
    names = ["score", "lang_pred", "held_out", "n_hit", "n_words", "contaminated", "n_removed", "n_sentences", "_id", "_gone", "gone", "n", "again", "key", "own_5", "c0", "kept", "component_id", "a b"]
    spark.createDataFrame([(1, prose(rnd, words, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id"), F.lit(-1))))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{i}:{-1 if r['doc_id'] is None else r['doc_id']}" for r in found for i, c in enumerate(names))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 16
