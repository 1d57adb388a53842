"""Feature stage (Entry B) as registered queries over the web judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions.constants import DEFAULT_PUBLIC_SUFFIXES, QD_FEATURE_NAMES
from ranklane.operators import features as fx
from ranklane.plans import oracle_features  # noqa: F401  (registers the oracle views)
from ranklane.plans.q_judge import JUDGEMENTS_VERSION, judgement_table
from ranklane.plans.registry import finish, register
from ranklane.sources.tables import web_collection

#: raise with any change of what the stage computes
FEATURES_VERSION = 2


def feature_stage(spark, sf_dir):
    """Judgements → features for the web collection (built lazily; the
    collection statistics are two bounded scalar jobs)."""
    c = web_collection(spark, sf_dir)
    return fx.features_stage(judgement_table(spark, sf_dir), c.docs, c.queries, DEFAULT_PUBLIC_SUFFIXES,
                             checkpoint=False)


def feature_table(spark, sf_dir):
    """The assembled feature rows, materialised once per state of the input
    and version in the shared checkpoint folder (a finished copy is reused:
    stage skip, S20)."""
    from ranklane.session import checkpoint_dir
    from ranklane.sources.formats import has_success, materialize, stage_path
    path = stage_path(spark, checkpoint_dir(spark), "features", FEATURES_VERSION,
                      [f"{sf_dir.rstrip('/')}/pages.parquet"], judgements=JUDGEMENTS_VERSION)
    if has_success(spark, path):
        return spark.read.parquet(path)
    return materialize(feature_stage(spark, sf_dir)["features"], path)


@register("q_features", "SELECT * FROM q_feat", ("q_feat",))
def q_features(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["q_features"])


@register("d_features", "SELECT * FROM d_feat_base", ("d_feat_base",))
def d_features(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["d_features_base"])


@register("qd_matched_terms", """
SELECT p.query_id, p.doc_id, v.field, qt.term, qt.qtf, v.tf
FROM (SELECT DISTINCT query_id, doc_id FROM judgements_webf) p
JOIN jqterms qt ON qt.query_id = p.query_id
JOIN jvpost v ON v.doc_id = p.doc_id AND v.term = qt.term
""", ("judgements_webf", "jqterms", "jvpost"))
def qd_matched_terms(spark, sf_dir):
    st = feature_stage(spark, sf_dir)
    pairs = judgement_table(spark, sf_dir).select("query_id", "doc_id").distinct()
    m = fx.qd_matched_terms(pairs, st["query_terms"], st["bags"])
    return finish(m.select("query_id", "doc_id", "field", "term", "qtf", "tf"))


QD_COLS = [f"{f}_{n}" for f in ("title", "text") for n in QD_FEATURE_NAMES]


@register("qd_features", "SELECT * FROM qd_feat", ("qd_feat",))
def qd_features(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["qd_features"])


BM25_COLS = ["title_bm25", "text_bm25", "title_log_bm25", "text_log_bm25"]
LM_COLS = [f"{f}_{n}" for f in ("title", "text") for n in ("lm_dir", "lm_jm", "lm_abs")]


@register("bm25_feature", f"SELECT query_id, doc_id, {', '.join(BM25_COLS)} FROM qd_feat", ("qd_feat",))
def bm25_feature(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["qd_features"].select("query_id", "doc_id", *BM25_COLS))


@register("lm_features", f"SELECT query_id, doc_id, {', '.join(LM_COLS)} FROM qd_feat", ("qd_feat",))
def lm_features(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["qd_features"].select("query_id", "doc_id", *LM_COLS))


@register("judged_doc_join", """
SELECT j.query_id, j.doc_id, j.relevance, d.sentence_count, f.text_len, d.sld
FROM judgements_webf j JOIN jdetails d ON d.doc_id = j.doc_id JOIN d_feat_base f ON f.doc_id = j.doc_id
""", ("judgements_webf", "jdetails", "d_feat_base"))
def judged_doc_join(spark, sf_dir):
    st = feature_stage(spark, sf_dir)
    j = (judgement_table(spark, sf_dir)
         .join(st["details"].select("doc_id", "sentence_count", "sld"), "doc_id")
         .join(st["d_features_base"].select("doc_id", "text_len"), "doc_id"))
    return finish(j.select("query_id", "doc_id", "relevance", "sentence_count", "text_len", "sld"))


@register("judged_query_join", """
SELECT j.query_id, j.doc_id, j.relevance, len(q.tokens) AS n_tokens, f.query_length, f.idf_sum
FROM judgements_webf j JOIN jqdet q ON q.query_id = j.query_id JOIN q_feat f ON f.query_id = j.query_id
""", ("judgements_webf", "jqdet", "q_feat"))
def judged_query_join(spark, sf_dir):
    st = feature_stage(spark, sf_dir)
    judg = judgement_table(spark, sf_dir)
    qd = st["query_details"].select("query_id", F.size("tokens").alias("n_tokens"))
    missing = judg.join(qd, "query_id", "left_anti")
    if missing.take(1):
        raise KeyError("judged query without details")
    j = (judg.join(qd, "query_id")
         .join(st["q_features"].select("query_id", "query_length", "idf_sum"), "query_id"))
    return finish(j.select("query_id", "doc_id", "relevance", "n_tokens", "query_length", "idf_sum"))


@register("assemble_features", "SELECT * FROM features_webf", ("features_webf",))
def assemble_features(spark, sf_dir):
    return finish(feature_stage(spark, sf_dir)["features"])


LTR = fx.ltr_index()


@register("feature_subset", "SELECT query_id, doc_id, relevance, "
          + ", ".join(f"f{i} AS s{k}" for k, i in enumerate(LTR)) + " FROM features_webf",
          ("features_webf",))
def feature_subset(spark, sf_dir):
    n = len(fx.feature_names())
    v = fx.feature_subset(fx.to_vector(feature_stage(spark, sf_dir)["features"], n), LTR)
    return finish(v.select("query_id", "doc_id", "relevance",
                           *[F.get("features", k).alias(f"s{k}") for k in range(len(LTR))]))
