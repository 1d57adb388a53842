"""Formats: LETOR (F8), TSV, id lists, stages."""

from pyspark.sql import functions as F

from ranklane.session import scratch_path
from ranklane.sources import formats as io


def test_letor_parse(spark):
    lines = spark.createDataFrame([("1 qid:12 1:0.5 2:-1.25e-3 3:7 # doc_id=00ab",),
                                   ("0 qid:13 1:1.0 2:2.0",)], "value string")
    got = {r["qid"]: r for r in io.parse_letor(lines).collect()}
    assert got["12"]["relevance"] == 1 and got["12"]["features"] == [0.5, -0.00125, 7.0]
    assert got["12"]["doc_id"] == "00ab"
    assert got["13"]["comment"] == "" and got["13"]["doc_id"] == "_"


def test_letor_write_parse_round_trip(spark):
    df = spark.createDataFrame([(1, "7", [0.25, -3.5], "d1")], "rel int, qid string, f array<double>, doc string")
    line = df.select(io.letor_line(F.col("rel"), F.col("qid"), F.col("f"), F.col("doc")).alias("value"))
    assert line.first()["value"] == "1 qid:7 1:0.25 2:-3.5 # doc_id=d1"
    back = io.parse_letor(line).first()
    assert back["features"] == [0.25, -3.5] and back["doc_id"] == "d1"


def test_tsv_keeps_whitespace_and_empty(spark):
    path = scratch_path(spark, "t-tsv")
    df = spark.createDataFrame([(1, "  padded ", ""), (2, 'quote "x"', "b")], "id long, a string, b string")
    io.write_tsv(df, path)
    back = sorted(tuple(r) for r in io.read_tsv(spark, path, "id long, a string, b string").collect())
    assert back == [(1, "  padded ", ""), (2, 'quote "x"', "b")]


def test_id_list_strips_and_dedups(spark):
    path = scratch_path(spark, "t-ids")
    ids = spark.createDataFrame([("  a ",), ("a",), ("b",), ("   ",)], "id string")
    io.write_id_list(ids, path, "id")
    assert sorted(r["id"] for r in io.load_id_set(spark, path).collect()) == ["a", "b"]


def test_materialize_skips_when_present(spark):
    path = scratch_path(spark, "t-stage")
    df = spark.range(5)
    assert io.materialize(df, path).count() == 5
    assert io.materialize(spark.range(7), path).count() == 5  # finished copy is reused
    assert io.materialize(spark.range(7), path, override=True).count() == 7


def test_full_doubles_survive_letor(spark):
    values = [1 / 3, 1e-9, -2.5e17, 0.1 + 0.2]
    df = spark.createDataFrame([(0, "1", values, "d")], "rel int, qid string, f array<double>, doc string")
    line = df.select(io.letor_line(F.col("rel"), F.col("qid"), F.col("f"), F.col("doc")).alias("value"))
    assert io.parse_letor(line).first()["features"] == values


def test_stage_path_follows_input_and_parameters(spark):
    from ranklane.session import checkpoint_dir
    path, base = scratch_path(spark, "t-input"), checkpoint_dir(spark)
    spark.range(3).write.parquet(path)
    one = io.stage_path(spark, base, "x", 1, [path], limit=3)
    assert one == io.stage_path(spark, base, "x", 1, [path], limit=3)
    assert one != io.stage_path(spark, base, "x", 1, [path], limit=4)
    assert one != io.stage_path(spark, base, "x", 2, [path], limit=3)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert one != io.stage_path(spark, base, "x", 1, [path], limit=3)


def test_store_without_order_keeps_the_smallest_row(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 5, "y")], "k string, n int, s string")
    got = sorted(tuple(r) for r in io.save_store(df, scratch_path(spark, "t-store"), "k").collect())
    assert got == [("a", 1, "z"), ("b", 5, "y")]
