from quillmatch.plans.params import Params
from quillmatch.streaming.references import read_stream, running_frequency


def test_running_frequency(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("X1,JO SMITH\nmalformed\nX2,AN SMITH\n")
    query = running_frequency(read_stream(spark, str(folder), Params())).writeStream.format("memory").queryName("running").outputMode("complete").start()
    try:
        query.processAllAvailable()
        (folder / "b.txt").write_text("X3,SMITH\n")
        query.processAllAvailable()
        assert {tuple(r) for r in spark.sql("SELECT token, n FROM running").collect()} == {("JO", 1), ("AN", 1), ("SMITH", 3)}
    finally:
        query.stop()
