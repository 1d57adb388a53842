"""Metrics on hand-made rankings (F6) and properties."""

import math

import pytest

from ranklane.operators import metrics


def frames(spark, run, qrels):
    r = spark.createDataFrame(run, "query_id string, doc_id string, score double")
    q = spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int")
    return r, q


RUN = [("a", "d1", 3.0), ("a", "d2", 2.0), ("a", "d3", 2.0), ("a", "d4", 1.0),
       ("b", "d1", 1.0), ("b", "d2", 0.5), ("c", "d9", 1.0)]
QRELS = [("a", "d2", 1), ("a", "d3", 2), ("a", "d4", 0), ("b", "d5", 1), ("c", "d9", 0)]


def vals(df):
    return {r["query_id"]: r["value"] for r in df.collect()}


def test_ndcg_ties_broken_by_doc_id(spark):
    r, q = frames(spark, RUN, QRELS)
    got = vals(metrics.ndcg_at_k(r, q, 10))
    dcg = 1 / math.log2(3) + 2 / math.log2(4)  # d2 at rank 2, d3 at rank 3 (tie → doc id)
    idcg = 2 / math.log2(2) + 1 / math.log2(3)
    assert got["a"] == pytest.approx(dcg / idcg)
    assert got["b"] == 0.0 and got["c"] == 0.0  # positive not retrieved; no positive at all


def test_err_uses_query_max_grade(spark):
    r, q = frames(spark, RUN, QRELS)
    got = vals(metrics.err_at_k(r, q, 10))
    r2, r3 = (2 ** 1 - 1) / 2 ** 2, (2 ** 2 - 1) / 2 ** 2
    assert got["a"] == pytest.approx(r2 / 2 + (1 - r2) * r3 / 3)


def test_map_counts_unretrieved_positives(spark):
    r, q = frames(spark, RUN, QRELS)
    got = vals(metrics.map_metric(r, q))
    assert got["a"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got["b"] == 0.0 and got["c"] == 0.0


def test_ideal_order_gives_one_and_bounds(spark):
    run = [("q", f"d{i}", float(10 - i)) for i in range(6)]
    qrels = [("q", f"d{i}", r) for i, r in enumerate([2, 2, 1, 1, 0, 0])]
    r, q = frames(spark, run, qrels)
    assert vals(metrics.ndcg_at_k(r, q, 10))["q"] == pytest.approx(1.0)
    for m in (metrics.ndcg_at_k, metrics.err_at_k, metrics.map_metric):
        for v in vals(m(*frames(spark, RUN, QRELS))).values():
            assert 0.0 <= v <= 1.0


def test_all_row_is_mean(spark):
    r, q = frames(spark, RUN, QRELS)
    per = metrics.ndcg_at_k(r, q, 10)
    rows = {x["query_id"]: x["value"] for x in metrics.with_all_row(per).collect()}
    assert rows["all"] == pytest.approx(sum(v for k, v in rows.items() if k != "all") / 3)
