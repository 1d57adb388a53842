"""Bins and splits (F4, F5) and their properties."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from ranklane.operators import domains as dm


def bins(spark, values, k):
    df = spark.createDataFrame([(f"q{i:03d}", float(v)) for i, v in enumerate(values)],
                               "query_id string, value double")
    return {r["query_id"]: r["domain_id"] for r in dm.equal_freq_domains(df, k).collect()}


def test_equal_frequency_bins(spark):
    b = bins(spark, [5, 3, 1, 7, 2, 2, 9], 3)
    sizes = [list(b.values()).count(i) for i in range(3)]
    assert sizes == [3, 2, 2]
    order = sorted(b, key=lambda q: ([5, 3, 1, 7, 2, 2, 9][int(q[1:])], q))
    assert [b[q] for q in order] == [0, 0, 0, 1, 1, 2, 2]
    assert sorted(bins(spark, [1, 2], 3).values()) == [0, 1]


def split_sizes(spark, n):
    df = spark.createDataFrame([(f"q{i}", 0) for i in range(n)], "query_id string, domain_id int")
    rows = dm.split_queries(df).collect()
    return {s: sum(1 for r in rows if r["step"] == s) for s in ("train", "valid", "test")}


def test_split_sizes(spark):
    assert split_sizes(spark, 1) == {"train": 1, "valid": 0, "test": 0}
    assert split_sizes(spark, 2) == {"train": 1, "valid": 0, "test": 1}
    assert split_sizes(spark, 7) == {"train": 4, "valid": 1, "test": 2}
    assert split_sizes(spark, 90) == {"train": 62, "valid": 13, "test": 15}  # 90 * 0.7 as DOUBLE


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=60))
def test_split_property(spark, n):
    s = split_sizes(spark, n)
    assert sum(s.values()) == n
    assert s["train"] == max(1, math.floor(n * 0.7))


def test_split_domains_exact_counts(spark):
    rows = dm.split_domains(spark, 8).collect()
    steps = [r["meta_step"] for r in rows]
    assert (steps.count("train"), steps.count("valid"), steps.count("test")) == (5, 1, 2)
    assert sorted(r["domain_id"] for r in rows) == list(range(8))


def test_cluster_registry_and_unknown(spark):
    import pytest
    df = spark.createDataFrame([(f"q{i}", float(i)) for i in range(9)], "query_id string, f0 double")
    eq = {r["query_id"]: r["domain_id"] for r in dm.cluster("equal_freq", df, 3).collect()}
    assert sorted(eq.values()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert dm.cluster("random", df, 3).count() == 9
    with pytest.raises(ValueError):
        dm.cluster("spectral", df, 3)


def test_a_query_without_a_domain_fails(spark):
    import pytest
    feats = spark.createDataFrame([(1, "q1", "d1", 0.5), (0, "q2", "d2", 0.7)], "relevance int, query_id string, doc_id string, f0 double")
    split = spark.createDataFrame([("q1", 0, "train")], "query_id string, domain_id int, step string")
    steps = spark.createDataFrame([(0, "train")], "domain_id int, meta_step string")
    assert dm.divide_dataset(feats.where("query_id = 'q1'"), split, steps, [0]).count() == 1
    with pytest.raises(Exception, match="for query q2"):
        dm.divide_dataset(feats, split, steps, [0]).collect()


def test_domain_vectors_by_name(spark):
    import pytest
    rows = [("train", 0, "train", 1, "q1", 2.0), ("train", 0, "train", 0, "q1", 0.0)]
    d = spark.createDataFrame(rows, "meta_step string, domain_id int, step string, relevance int, query_id string, s0 double")
    assert dm.domain_vectors("all_rows", d).first()["s0"] == 1.0
    assert dm.domain_vectors("positive_rows", d).first()["s0"] == 2.0
    with pytest.raises(ValueError):
        dm.domain_vectors("other", d)


def test_kmeans_fits_run_side_by_side(spark, monkeypatch):
    """Two fits must be under way at once to pass the barrier; the cheapest one stays."""
    import threading

    from pyspark.ml import clustering
    met = threading.Barrier(2, timeout=60)

    fit = clustering.KMeans._fit

    def meeting(self, dataset):
        met.wait()
        return fit(self, dataset)

    monkeypatch.setattr(clustering.KMeans, "_fit", meeting)
    v = spark.createDataFrame([(f"q{i}", float(i // 4)) for i in range(8)], "query_id string, f0 double")
    got = {r.query_id: r.domain_id for r in dm.kmeans_domains(v, 2, seeds=range(2)).collect()}
    assert len({got[f"q{i}"] for i in range(4)}) == 1 and len(set(got.values())) == 2
