import pytest
from pyspark.sql import functions as F

from ranklane.llm import toxicity as tx
from ranklane.llm.common import held_out

LABELS = "doc_id long, toxic int"


def test_features_by_hand():
    x = tx.Extractor(tx.Lexicon({"blargh": 2.0}, {"blarg": 1.5}), cache=2)
    f = dict(zip(tx.FEATURES, x("You are an 1D!OT and a BLARGH, blarghhh b@d.")))
    assert f["any_insult"] == 1 and f["insults"] == pytest.approx(1 / 9)
    assert f["lexicon_hits"] == 1 and f["lexicon_most"] == 2.0 and f["stems_most"] == 1.5
    assert f["near_second_person"] == 1  # the insult; the learned word is further off
    assert f["second_person"] == pytest.approx(1 / 9) and f["capital_words"] > 0 and f["obfuscated"] > 0 and f["long_letters"] > 0
    assert not x("").any() and not x(None).any()


def test_held_out_documents_are_ranked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = [(r.toxic, r.score, r.predicted) for r in tx.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()]
    bad, good = [s for t, s, _ in got if t], [s for t, s, _ in got if not t]
    wins = sum((b > g) + (b == g) / 2 for b in bad for g in good)
    assert wins / (len(bad) * len(good)) > 0.95
    assert sum(p for t, _, p in got if not t) <= 0.01 * len(good)
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    blind = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), F.lit(1) - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tx.score_toxicity(docs, x).collect()} for x in (labels, blind))
    assert a == b


def test_odd_rows_and_few_labels(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (4, 0), (None, 1)], LABELS).withColumn("text", F.lit("x"))
    rows = tx.score_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows}) == 1
    assert {r.score for r in tx.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert tx.score_toxicity(empty, labels).count() == 0
