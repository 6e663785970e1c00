from pyspark.sql import functions as F

from quillmatch.functions.text import base_name, compress, compress_numbers, split_name_address, splitter


def one(spark, f, body):
    return spark.createDataFrame([(body,)], "b string").select(f(F.col("b"))).first()[0]


def test_splitter(spark):
    assert one(spark, splitter, "O'Neil,12-B  Main_St") == ["O", "NEIL", "12", "B", "MAIN_ST"]
    assert one(spark, splitter, None) == []
    assert one(spark, splitter, " ,; ") == []


def test_compress(spark):
    assert one(spark, compress, "O'Neil,12-B  Main_St") == ["ONEIL", "12B", "MAIN_ST"]


def test_compress_numbers(spark):
    assert one(spark, compress_numbers, "JO 555 12 34,ST # 7") == ["JO", "5551234", "ST", "", "7"]


def test_compress_numbers_with_a_delimiter_that_is_a_pattern(spark):
    out = spark.createDataFrame([("A 1 2|3 B",)], "b string").select(compress_numbers(F.col("b"), "|")).first()[0]
    assert out == ["A", "12", "3", "B"]


def test_name_address(spark):
    df = spark.createDataFrame([(["A", "B1", "C"],), (["A"],), (["1"],), ([],)], "t array<string>")
    name, address = split_name_address(F.col("t"))
    assert [tuple(r) for r in df.select(name, address).collect()] == [(["A"], ["B1", "C"]), (["A"], []), ([], ["1"]), ([], [])]


def test_base_name():
    assert base_name("a/b.c/people.txt") == "people"
    assert base_name("plain") == "plain"
