"""Ranking features on hand-made micro-collections (F1, F2) against a
plain-Python restatement of the formulas."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranklane.functions.constants import STOP_WORDS
from ranklane.operators import features as fx
from ranklane.operators import stats as st

DOCS = [  # doc_id, title, text, url
    ("d1", "Cats and dogs", "Cats chase dogs. Dogs chase cats! Birds fly.", "http://a.example.com/x/y"),
    ("d2", "", "Only text here about cats.", "http://b.example.org/"),
    ("d3", "Birds", "", None),
]
QUERIES = [("q1", "cats dogs birds cats"), ("q2", "the and of")]
JUDG = [("q1", "d1", 1), ("q1", "d2", 0), ("q1", "d3", 0), ("q2", "d1", 1), ("q2", "d3", 0)]


def toks(s):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", (s or "").lower())


def valid(ts):
    return [t for t in ts if t not in STOP_WORDS and t.isalnum()]


def py_collection():
    df, cf, dn, cn = Counter(), Counter(), 0, 0
    for _, title, text, _ in DOCS:
        for field in (title, text):
            bag = Counter(toks(field))
            for w, c in bag.items():
                df[w] += 1
                cf[w] += c
                cn += c
            dn += 1
    return df, cf, dn, cn


def py_qd(q, d, df, cf, dn, cn):
    """Plain restatement of the 15 formulas."""
    V = len(df)
    dlen = sum(d.values())
    m = set(q) & set(d)
    out = {}
    out["tf_sum"] = sum(d[w] for w in m)
    out["log_tf_sum"] = sum(math.log(d[w] + 1) for w in m)
    out["norm_tf_sum"] = out["tf_sum"] / dlen if dlen else out["tf_sum"]
    out["log_norm_tf_sum"] = sum(math.log(d[w] / dlen + 1) for w in m)
    out["idf_sum"] = sum(math.log(dn / df[w]) for w in m)
    out["log_idf_sum"] = sum(math.log(math.log(dn / df[w])) for w in m if math.log(dn / df[w]) > 0)
    out["icf_sum"] = sum(math.log(dn / cf[w] + 1) for w in m)
    out["log_tfidf_sum"] = sum(math.log(d[w] / dlen * math.log(dn / df[w] + 1)) for w in m) if dlen else 0.0
    out["tfidf_sum"] = sum(d[w] * math.log(dn / df[w]) for w in m)
    out["tf_icf_sum"] = sum(math.log(d[w] / dlen * dn / cf[w] + 1) for w in m) if dlen else 0.0
    avg = cn / dn
    bm = 0.0
    if dlen:
        for w in m:
            idf = math.log((dn - df[w] + 0.5) / (df[w] + 0.5))
            bm += idf * d[w] * 3.5 / (d[w] + 2.5 * (1 - 0.8 + 0.8 * dlen / avg))
    out["bm25"] = bm
    out["log_bm25"] = math.log(bm + 1) if bm > 0 else 0.0
    qlen = sum(q.values())

    def p(w):
        return (cf.get(w, 0) + 1) / (cn + V)

    def lm(part, alpha_total):
        if not dlen:
            return 0.0
        r = 0.0
        for w in q:
            r += math.log(p(w))
            if w in d:
                r += part(w)
        return r + alpha_total
    if dlen:
        a = 50 / (dlen + 50)
        out["lm_dir"] = lm(lambda w: math.log(((d[w] + 50 * p(w)) / (dlen + 50)) / (a * p(w))), qlen * math.log(a))
        out["lm_jm"] = lm(lambda w: math.log((0.5 * d[w] / dlen + 0.5 * p(w)) / (0.5 * p(w))), qlen * math.log(0.5))
        a2 = 0.5 * len(d) / dlen
        out["lm_abs"] = lm(lambda w: math.log((max(0.0, d[w] - 0.5) / dlen + a2 * p(w)) / (a2 * p(w))),
                           qlen * math.log(a2))
    else:
        out["lm_dir"] = out["lm_jm"] = out["lm_abs"] = 0.0
    return out


@pytest.fixture(scope="module")
def stage(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, text string, url string")
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    judg = spark.createDataFrame(JUDG, "query_id string, doc_id string, relevance int")
    return fx.features_stage(judg, docs, queries, ["com", "org", "net"])


def test_collection_counts_empty_fields(stage):
    df, cf, dn, cn = py_collection()
    assert stage["coll"]["dn"] == dn == 6
    assert stage["coll"]["cn"] == cn
    got = {r["term"]: (r["df"], r["cf"]) for r in stage["term_stats"].collect()}
    assert got == {w: (df[w], cf[w]) for w in df}


def test_qd_features_match_formulas(stage):
    df, cf, dn, cn = py_collection()
    rows = {(r["query_id"], r["doc_id"]): r.asDict() for r in stage["qd_features"].collect()}
    for qid, text in QUERIES:
        q = Counter(valid(toks(text)))
        for (jq, jd, _) in JUDG:
            if jq != qid:
                continue
            doc = next(d for d in DOCS if d[0] == jd)
            for field, src in (("title", doc[1]), ("text", doc[2])):
                want = py_qd(q, Counter(valid(toks(src))), df, cf, dn, cn)
                for name, v in want.items():
                    assert rows[(qid, jd)][f"{field}_{name}"] == pytest.approx(v, abs=1e-9), (qid, jd, field, name)


def test_q_features_and_empty_query(stage):
    df, cf, dn, cn = py_collection()
    got = {r["query_id"]: r.asDict() for r in stage["q_features"].collect()}
    t = toks("cats dogs birds cats")
    idf = [math.log(dn / (df.get(w, 0) + 1)) + 1 for w in t]
    assert got["q1"]["query_length"] == 4
    assert got["q1"]["idf_sum"] == pytest.approx(sum(idf))
    assert got["q1"]["idf_max"] == pytest.approx(max(idf))
    mu = sum(idf) / len(idf)
    assert got["q1"]["idf_sd"] == pytest.approx(math.sqrt(sum((x - mu) ** 2 for x in idf) / len(idf)))
    assert got["q2"]["query_length"] == 0  # only stop words


def test_d_features(stage):
    got = {r["doc_id"]: r.asDict() for r in stage["d_features_base"].collect()}
    assert got["d1"]["sentence_count"] == 3
    assert got["d3"]["url_depth"] == 0 and got["d3"]["domain_length"] == 0 and got["d3"]["domain_freq"] == 1
    assert got["d1"]["url_depth"] == 2
    t = toks(DOCS[0][2])
    chars, words = sum(len(x) for x in t), len(t)
    assert got["d1"]["ari"] == pytest.approx(4.71 * chars / words + 0.5 * words / 3 - 21.43)


def test_assembled_width_and_subset(stage):
    f = stage["features"]
    n = len(fx.feature_names())
    assert n == 59 and len([c for c in f.columns if c.startswith("f")]) == 59
    assert f.count() == len(JUDG)
    v = fx.feature_subset(fx.to_vector(f, n), fx.ltr_index() + [999])
    assert v.select(F.size("features")).first()[0] == 37


def test_extra_qd_feature_plugin(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, text string, url string")
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    judg = spark.createDataFrame(JUDG, "query_id string, doc_id string, relevance int")
    st = fx.features_stage(judg, docs, queries, ["com", "org", "net"])
    extra = {"tf_sq": lambda coll: F.col("tf").cast("double") * F.col("tf")}
    q = fx.qd_features(judg.select("query_id", "doc_id"), st.query_terms, st.bags, st.term_stats, st.coll, extra=extra)
    row = q.where("query_id = 'q1' AND doc_id = 'd1'").first()
    # d1 text: cats 2, dogs 2, birds 1 match q1; title: cats 1, dogs 1
    assert row["text_tf_sq"] == 2 ** 2 + 2 ** 2 + 1 ** 2
    assert row["title_tf_sq"] == 2


def test_terms_are_found_by_halving_in_bags_of_any_size_and_order(spark):
    """Every term of a bag is found, none besides it, also in unsorted bags; the
    bag is not filtered for each term."""
    rows = [("d%d" % n, "text", n, [(f"t{(7 * i) % 97:02d}", i + 1) for i in range(n)]) for n in (0, 1, 2, 3, 8, 9, 33)]
    bags = spark.createDataFrame(rows, "doc_id string, field string, n_tokens int, bag array<struct<term:string,tf:bigint>>")
    terms = [f"t{i:02d}" for i in range(97)] + ["", "zz"]
    qterms = spark.createDataFrame([("q", t, 1) for t in terms], "query_id string, term string, qtf int")
    pairs = spark.createDataFrame([("q", r[0]) for r in rows], "query_id string, doc_id string")
    found = fx.qd_matched_terms(pairs, qterms, bags)
    got = sorted((r.doc_id, r.term, r.tf, r.nuniq) for r in found.collect())
    assert got == sorted((d, t, tf, n) for d, _, n, bag in rows for t, tf in bag)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_contains" not in plan


def test_words_are_the_valid_tokens_and_bags_are_made_once(spark):
    from ranklane.functions import text as tx
    from ranklane.operators import stats
    texts = ["The cat, and the hat! ÄRGER über 3.5 x² 漢字 naïve—co-op", "", None, "a {b} |c| ~d _e 'f'", "\U00010400\U00010428 Σας"]
    df = spark.createDataFrame([(str(i), t, t) for i, t in enumerate(texts)], "doc_id string, title string, text string")
    for r in df.select(tx.words("text").alias("a"), tx.valid_tokens(tx.tokenize("text")).alias("b")).collect():
        assert r.a == r.b
    fields = stats.field_token_arrays(df)
    kept = stats.valid_bags(stats.term_bags(fields))
    want = stats.term_bags(fields, True)
    assert kept.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))


def test_feature_stage_counts_terms_of_a_document_once(spark):
    """The valid bags come from the kept bags of all tokens, not from the tokens again."""
    from ranklane.operators import features as fx
    docs = spark.createDataFrame([("d", "A cat", "the cat sat", "http://a.b/c")], "doc_id string, title string, text string, url string")
    queries = spark.createDataFrame([("q", "cat")], "query_id string, text string")
    judged = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, relevance int")
    stage = fx.features_stage(judged, docs, queries, ["b"], checkpoint=False)
    assert stage.all_bags.storageLevel.useMemory
    assert {(r.field, r.n_tokens) for r in stage.bags.collect()} == {("title", 1), ("text", 2)}


def test_a_probe_comes_after_all_tasks_parsed(spark):
    from ranklane.plans.stages import declared_languages, judgements_stage
    from ranklane.sources.tables import Collection, web_qrels, web_queries
    docs = spark.range(8, numPartitions=8).selectExpr(
        "string(id) doc_id", "'t' title", "'one two three four five six seven' text", "'u' url", "'en' lang").persist()
    stage = judgements_stage(Collection(docs, web_queries(docs), web_qrels(docs)), *declared_languages(docs))
    assert stage.kept_queries.count() == 8
    assert stage.parsed == 8
    docs.unpersist()
