"""z-scores (F9) and coordinate ascent."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ranklane.operators import ltr
from ranklane.operators.stats import zscore_per_query


def test_zscore_constant_and_single(spark):
    rows = [("q1", "a", 0, 5.0), ("q1", "b", 0, 5.0), ("q1", "a", 1, 1.0), ("q1", "b", 1, 3.0),
            ("q2", "c", 0, 7.0)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, idx int, value double")
    z = {(r["query_id"], r["doc_id"], r["idx"]): r["z"] for r in zscore_per_query(df).collect()}
    assert z[("q1", "a", 0)] == 0.0 and z[("q2", "c", 0)] == 0.0
    assert z[("q1", "a", 1)] == pytest.approx(-1 / 2 ** 0.5)


def test_coordinate_ascent_finds_informative_feature(spark):
    rng = random.Random(7)
    rows = []
    for dom in range(2):
        for q in range(20):
            for d in range(6):
                rel = 1 if d < 2 else 0
                x0 = rel * 2.0 + rng.gauss(0, 0.3)
                rows.append((dom, f"q{dom}_{q}", f"d{d}", rel, x0, rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "domain_id int, query_id string, doc_id string, relevance int, "
                                     "s0 double, s1 double, s2 double")
    z = ltr.zscore_wide(df, ["domain_id"])
    w = ltr.coordinate_ascent(z, ["domain_id"], 3, restarts=2)
    for dom in range(2):
        ws = {r["idx"]: r["w"] for r in w.where((F.col("domain_id") == dom) & (F.col("restart") == 0)).collect()}
        assert abs(ws[0]) == max(abs(v) for v in ws.values())
        obj = w.where(F.col("domain_id") == dom).agg(F.max("objective")).first()[0]
        assert obj > 0.9  # the objective never drops below the start; the data is separable


def test_score_models_global_and_own(spark):
    z = spark.createDataFrame([(0, "q", "a", 1, 1.0, 2.0)],
                              "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double")
    w = spark.createDataFrame([("ideal", 0, 0, 0.5), ("ideal", 0, 1, 1.0), ("global", None, 0, 2.0),
                               ("global", None, 1, 0.0)], "model string, domain_id int, idx int, w double")
    got = {r["model"]: r["score"] for r in ltr.score_wide(z, w).collect()}
    assert got == {"ideal": 2.5, "global": 2.0}


def test_noise_in_a_constant_feature_is_no_deviation(spark):
    """Sums of equal terms in another order differ in the last bits; such a
    feature is constant, on the long form and the wide one."""
    base = 5.05
    rows = [(0, "q", f"d{i}", 1, base * (1 + (i % 3) * 2.2e-16), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double")
    wide = ltr.zscore_wide(df, ["domain_id"]).collect()
    assert {r.s0 for r in wide} == {0.0} and len({r.s1 for r in wide}) == 6
    long = zscore_per_query(ltr.to_long(df, ["domain_id"])).collect()
    assert {r.z for r in long if r.idx == 0} == {0.0} and len({r.z for r in long if r.idx == 1}) == 6
    from ranklane.operators.stats import standard_scale
    scaled = standard_scale(df, "doc_id", ["s0", "s1"]).collect()
    assert all(abs(r.s0) < 1e-12 for r in scaled) and max(r.s1 for r in scaled) > 1


def _lists(spark, seed=3, queries=8, docs=7, ties=False):
    rng = random.Random(seed)
    value = (lambda: float(rng.randint(-2, 2))) if ties else (lambda: rng.gauss(0, 1))
    rows = [(0, f"q{q}", f"d{d}", rng.choice([0, 0, 1, 2]), value(), value(), value()) for q in range(queries) for d in range(docs)]
    df = spark.createDataFrame(rows, "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double, s2 double")
    return rows, ltr.query_lists(df, ["domain_id"], 3).withColumn("mk", F.lit("0"))


def plain_ndcg(rows, w, k=10):
    """Sum over lists of NDCG@k of the scores w·z."""
    total = 0.0
    for q in sorted({r[1] for r in rows}):
        docs = [r for r in rows if r[1] == q]
        gains = lambda order: sum((2 ** r[3] - 1) / math.log2(i + 2) for i, r in enumerate(order[:k]))
        ideal = gains(sorted(docs, key=lambda r: -r[3]))
        if ideal:
            total += gains(sorted(docs, key=lambda r: (-round(sum(a * b for a, b in zip(w, r[4:])), 9), r[2]))) / ideal
    return total


@pytest.mark.parametrize("ties", [False, True])
def test_line_search_equals_brute_force_over_the_meetings(spark, ties):
    rows, lists = _lists(spark, ties=ties)
    w = [0.5, -0.3, 0.2]
    state = spark.createDataFrame([("0", 0, w, [2, 0, 1], True)], "mk string, restart int, w array<double>, order array<int>, live boolean")
    for pos, f in enumerate([2, 0, 1]):
        found = [(r.delta, r.value) for r in ltr.stretches(ltr.line_events(lists, state, pos)).collect()]
        for delta, value in found:
            assert value == pytest.approx(plain_ndcg(rows, [x + delta * (i == f) for i, x in enumerate(w)]), abs=1e-9)
        cuts = set()
        for q in {r[1] for r in rows}:
            docs = [r[4:] for r in rows if r[1] == q]
            for a in docs:
                for b in docs:
                    if a[f] > b[f]:
                        cuts.add(round((sum(x * y for x, y in zip(w, b)) - sum(x * y for x, y in zip(w, a))) / (a[f] - b[f]), 9))
        cuts = sorted(cuts)
        places = [cuts[0] - 1, *[(a + b) / 2 for a, b in zip(cuts, cuts[1:]) if b - a > 1e-6], cuts[-1] + 1]
        best = max(plain_ndcg(rows, [x + p * (i == f) for i, x in enumerate(w)]) for p in places)
        assert max(v for _, v in found) == pytest.approx(best, abs=1e-9)
        # a stretch holds 0 or ends near it
        here = min(found, key=lambda e: abs(e[0]))
        assert here[1] == pytest.approx(plain_ndcg(rows, w), abs=1e-9) or ties


def test_ascent_ends_where_no_coordinate_gains(spark):
    rows, _ = _lists(spark, seed=9)
    df = spark.createDataFrame(rows, "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double, s2 double")
    got = ltr.coordinate_ascent(df, ["domain_id"], 3, restarts=3, reg=0.0, tolerance=0.001).collect()
    ends = {}
    for r in got:
        ends.setdefault(r.restart, [0, 0, 0, 0])[r.idx] = r.w
        ends[r.restart][3] = r.objective
    assert len(ends) == 3 and len({tuple(round(x, 6) for x in e[:3]) for e in ends.values()}) > 1
    for *w, objective in ends.values():
        assert sum(map(abs, w)) == pytest.approx(1) and objective == pytest.approx(plain_ndcg(rows, w) / 8, abs=1e-8)
        for f in range(3):
            for step in range(-200, 201):
                moved = [x + step / 50 * (i == f) for i, x in enumerate(w)]
                assert plain_ndcg(rows, moved) / 8 <= objective + 0.0011


def test_starts_are_seeded(spark):
    _, lists = _lists(spark)
    a, b, c = ([(r.restart, r.w, r.order) for r in ltr.start_state(lists, 3, 4, seed).orderBy("restart").collect()] for seed in (1, 1, 2))
    assert a == b and a[0] == c[0] and a[1:] != c[1:] and len({tuple(w) for _, w, _ in a}) == 4
    assert all(sorted(o) == [0, 1, 2] for _, _, o in a)


@pytest.mark.parametrize("ties", [False, True])
def test_best_places_are_the_best_of_all_stretches(spark, ties):
    """The sweep in tasks finds what the table of all stretches has, wherever
    its groups are dealt (a coordinate was a checkpointed job of many stages)."""
    import numpy as np
    _, lists = _lists(spark, seed=5, ties=ties)
    w, start = np.array([[0.5, -0.3, 0.2], [-0.1, 0.6, 0.3]]), np.array([[1 / 3] * 3, [0.2, 0.4, -0.4]])
    state = spark.createDataFrame([("0", i, x.tolist(), [2, 0, 1], True) for i, x in enumerate(w)],
                                  "mk string, restart int, w array<double>, order array<int>, live boolean")
    for pos, f in enumerate([2, 0, 1]):
        every = ltr.stretches(ltr.line_events(lists, state, pos)).collect()
        for reg in (0.0, 0.1):
            line = ltr.Line(w, start, np.array([f, f]), np.array([8.0, 8.0]), reg)
            want = {}
            for r in every:
                o = round(float(line.objective(np.array([r.restart]), np.array([r.delta]), np.array([r.value]))[0]), 10)
                want[r.restart] = max(want.get(r.restart, (-9.0, 0, 0)), (o, -abs(round(r.delta, 9)), round(r.delta, 9)))
            for n_parts in (1, 3):
                m, o, delta = ltr.best_places(ltr.packed_lists(lists, 2), n_parts, {"0": np.array([0, 1])}, w, np.array([f, f]), line, 10)
                got = {int(i): (x, -abs(round(d, 9)), round(d, 9)) for i, x, d in zip(m, o.tolist(), delta.tolist())}
                assert got.keys() == want.keys()
                for i in got:
                    assert got[i] == pytest.approx(want[i], abs=2e-9)


def test_wide_zscores_follow_the_long_form_without_windows(spark):
    """Nulls, a constant column, a list of one, a null query: as the window form; no sort of wide rows per feature."""
    rows = [(0, "q", "a", 1, 1.0, None), (0, "q", "b", 0, 3.0, 2.0), (0, "q", "c", 0, 8.0, 5.0), (0, None, "a", 0, 1.0, 4.0),
            (0, None, "a", 0, 2.0, 4.0), (1, "q", "a", 1, 7.0, None), (1, "r", "x", 0, float("inf"), 1.0), (1, "r", "y", 0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "domain_id int, query_id string, doc_id string, relevance int, s0 double, s1 double")
    wide = ltr.zscore_wide(df, ["domain_id"])
    assert wide.schema.names == ["domain_id", "query_id", "doc_id", "relevance", "s0", "s1"]
    assert "Window" not in wide._jdf.queryExecution().executedPlan().toString()
    got = [(r[:4], (r.s0, r.s1)[i], i) for r in wide.collect() for i in range(2)]
    want = [((r.domain_id, r.query_id, r.doc_id, r.relevance), r.z, r.idx)
            for r in zscore_per_query(ltr.to_long(df, ["domain_id"]), keys=("domain_id", "query_id")).collect()]
    order = lambda x: (str(x[0]), x[2], x[1] is None, x[1] or 0.0)
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert all(g[1] == w[1] or g[1] == pytest.approx(w[1]) for g, w in zip(got, want))


def test_scores_of_all_models_make_the_rows_once(spark):
    z = spark.createDataFrame([(0, "q", "a", 1, 1.0), (None, "r", "b", 0, 2.0)],
                              "domain_id int, query_id string, doc_id string, relevance int, s0 double")
    w = spark.createDataFrame([("ideal", 0, 0, 0.5), ("global", None, 0, 2.0)], "model string, domain_id int, idx int, w double")
    scored = ltr.score_wide(ltr.zscore_wide(z, ["domain_id"]), w)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.model, r.domain_id, r.doc_id) for r in ltr.score_wide(z, w).collect()}
    assert got == {("ideal", 0, "a"), ("global", 0, "a"), ("global", None, "b")}


def test_only_bins_that_can_hold_the_best_place_are_swept():
    """The best place of a line of many events is between two bins or in one that
    is kept; few bins are."""
    import numpy as np
    rng = np.random.default_rng(4)
    models, n, features, fine = 3, 40_000, 5, 16
    w = rng.normal(size=(models, features))
    w /= np.abs(w).sum(1, keepdims=True)
    line = ltr.Line(w, np.roll(w, 1, 0), np.array([0, 2, 4]), np.full(models, n / 10.0), 0.1)
    m, delta = rng.integers(0, models, n), rng.standard_cauchy(n)
    dv = rng.normal(size=n) * 0.05 - np.tanh(delta - 0.3) * 0.1
    bins = 128 * fine + 1
    cell = m * bins + ltr._bin_of(delta, fine)
    least, last = np.full(models * bins, np.inf), np.full(models * bins, -np.inf)
    np.minimum.at(least, cell, delta)
    np.maximum.at(last, cell, delta)
    sums = np.bincount(cell, dv, models * bins), np.bincount(cell, np.maximum(dv, 0), models * bins), least, last
    base, between, matter = ltr._cells_that_matter(*(x.reshape(models, bins) for x in sums), line)
    assert np.bincount(cell, minlength=models * bins)[matter.ravel()].sum() < n / 5
    for i in range(models):
        order = np.argsort(delta[m == i])
        d, v = delta[m == i][order], np.cumsum(dv[m == i][order])
        at = ltr._place(d, np.append(d[1:], np.inf))
        wide = np.append(np.diff(d) > ltr.MIN_STRETCH, True)
        o = np.where(wide, line.objective(np.full(len(d), i), at, v), -np.inf)
        best = int(np.argmax(o))
        own = between[0] == i
        found = line.objective(between[0][own], between[1][own], between[2][own]).max()
        assert matter[i, ltr._bin_of(d[best:best + 1], fine)[0]] or found >= o[best] - 1e-9
