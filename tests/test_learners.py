"""Properties of the learners."""

import pytest
from pyspark.sql import functions as F

from ranklane.operators import domains as dm
from ranklane.operators import features as fx
from ranklane.operators import ltr, meta, topics


@pytest.fixture(scope="module")
def topic_frame(spark):
    words = {"sea": ["wave", "salt", "ship"], "sky": ["cloud", "wing", "star"]}
    rows = [(t, f"{ws[i % 3]} {ws[(i + 1) % 3]} common w{i}") for t, ws in words.items() for i in range(20)]
    return topics.with_row_key(spark.createDataFrame(rows, "topic string, text string"))


def test_topic_probabilities_have_one_column_a_class(spark, topic_frame):
    model, search = topics.fit_topic_classifier(topic_frame, n_iter=2, folds=2)
    assert search.count() == 2 and search.where("C < 0.01 OR C > 100").count() == 0
    docs = spark.createDataFrame([("d1", "ship", "salt wave"), ("d2", None, "star cloud"), ("d3", "", "")],
                                 "doc_id string, title string, text string")
    got = {r.doc_id: r.probability for r in topics.topic_proba(model, docs).collect()}
    labels = model.stages[3].labels
    for p in got.values():
        assert len(p) == 2 and sum(p) == pytest.approx(1)
    assert labels[got["d1"].index(max(got["d1"]))] == "sea" and labels[got["d2"].index(max(got["d2"]))] == "sky"
    feats = docs.select("doc_id", *[F.lit(0.0).alias(c) for c in (*fx.D_BASE_NAMES, *fx.D_TAIL_NAMES)])
    wide = fx.with_topics(feats, topics.topic_proba(model, docs), 2)
    assert wide.select((F.col("topic_0") + F.col("topic_1")).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    with pytest.raises(Exception, match="13 topic columns for 2 classes"):
        fx.with_topics(feats, topics.topic_proba(model, docs), 13).collect()


def test_every_term_is_in_the_vocabulary_and_the_tokenizer_is_used(topic_frame):
    model, _ = topics.fit_topic_classifier(topic_frame, n_iter=1, folds=2, tokenizer=lambda c: F.split(c, " "))
    assert len(model.stages[0].vocabulary) == 3 + 3 + 1 + 20


def test_kmeans_finds_separated_groups(spark):
    rows = [(f"q{i}", float(10 * (i % 3)) + i / 1000, float(-5 * (i % 3))) for i in range(60)]
    got = dm.kmeans_domains(spark.createDataFrame(rows, "query_id string, f0 double, f1 double"), 3)
    groups = {}
    for r in got.collect():
        groups.setdefault(int(r.query_id[1:]) % 3, set()).add(r.domain_id)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3


@pytest.mark.parametrize("model", ["RandomForest", "GBT"])
def test_regressed_weights_follow_the_domain(spark, model):
    x = spark.createDataFrame([(d, float(d % 2)) for d in range(12)], "domain_id int, s0 double")
    w = spark.createDataFrame([(d, i, float((d % 2) * (i + 1))) for d in range(10) for i in range(2)],
                              "domain_id int, idx int, w double")
    got = meta.fit_predict_weights(x.where("domain_id < 10"), w, x.where("domain_id >= 10"), ["s0"], 2,
                                   {"numTrees": 10, "maxIter": 3}, model=model)
    assert {(r.domain_id, r.idx): round(r.w, 1) for r in got.collect()} == {
        (10, 0): 0.0, (10, 1): 0.0, (11, 0): 1.0, (11, 1): 2.0}


def test_trials_cover_the_documented_ranges():
    trials = meta.random_trials(200)
    assert {t["trial"] for t in trials} == set(range(200))
    assert all(50 <= t["numTrees"] <= 300 and 3 <= t["maxDepth"] <= 30 for t in trials)


def test_domain_vector_row_predicate(spark):
    d = spark.createDataFrame([("train", 0, "train", 1, "q", 2.0), ("train", 0, "valid", 1, "q", 4.0)],
                              "meta_step string, domain_id int, step string, relevance int, query_id string, s0 double")
    assert dm.domain_features(d, keep=F.col("step") == "valid").first()["s0"] == 4.0


def test_judged_lists_missing_from_the_run_count_as_zero(spark):
    from ranklane.operators import metrics
    run = spark.createDataFrame([("q1", "a", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1)], "query_id string, doc_id string, relevance int")
    for m in metrics.METRICS.values():
        got = {r.query_id: r.value for r in m(run, qrels).collect()}
        assert set(got) == {"q1", "q2"} and got["q1"] > 0 and got["q2"] == 0.0


def test_wide_scores_are_dot_products(spark):
    z = spark.createDataFrame([(0, "q", "a", 1, 1.0, 2.0), (1, "p", "b", 0, 3.0, -1.0)],
                              "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double")
    w = spark.createDataFrame([("own", 0, 0, 0.5), ("own", 0, 1, 1.0), ("all", None, 1, 2.0)],
                              "model string, domain_id int, idx int, w double")
    got = {(r.model, r.doc_id): r.score for r in ltr.score_wide(z, w).collect()}
    assert got == {("own", "a"): 2.5, ("all", "a"): 4.0, ("all", "b"): -2.0}


def test_fits_side_by_side_are_as_many_as_the_driver_holds():
    gb = 1 << 30
    assert topics.fits_at_once(8, 2_000, 5, gb) == 8
    assert topics.fits_at_once(8, 400_000, 5, gb) == 1
    assert topics.fits_at_once(8, 1 << 30, 13, gb) == 1 and topics.fits_at_once(8, 0, 0, gb) == 8
