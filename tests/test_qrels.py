"""Judgement operators."""

from ranklane.operators import qrels as qr


def test_negatives_and_positives(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", float(10 - i), i) for i in range(1, 7)],
                                   "query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("q", "d2"), ("q", "d5"), ("q", "dx")], "query_id string, doc_id string")
    j = {(r["doc_id"], r["relevance"]) for r in qr.attach_qrels(ranked, qrels, 2).collect()}
    # every positive is kept, even the one never retrieved; first 2 non-positives by rank
    assert j == {("d2", 1), ("d5", 1), ("dx", 1), ("d1", 0), ("d3", 0)}
    assert qr.negatives_topn(ranked, qrels, 0).count() == 1  # limit checked after appending
    assert qr.negatives_topn(ranked, qrels, 1).count() == 1


def test_filter_qrels_and_empty_guard(spark):
    import pytest
    qrels = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d1")], "query_id string, doc_id string")
    kq = spark.createDataFrame([("q1",)], "query_id string")
    kd = spark.createDataFrame([("d1",)], "doc_id string")
    assert [tuple(r) for r in qr.filter_qrels(qrels, kq, kd).collect()] == [("q1", "d1")]
    with pytest.raises(ValueError):
        qr.check_nonempty(kq.where("false"), "queries")


def test_max_positive_count(spark):
    qrels = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d1")], "query_id string, doc_id string")
    assert qr.max_positive_count(qr.relevant_doc_counts(qrels)) == 2
    assert qr.max_positive_count(qr.relevant_doc_counts(qrels.where("false"))) == 0
