"""Minimum slice: scans, tokens, statistics, BM25 top-k and nDCG@10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions.constants import CUTOFF, NEGATIVE_COUNT
from ranklane.operators import metrics, qrels as qr, retrieval, stats
from ranklane.plans.registry import finish, r6, register
from ranklane.sources.tables import conv_collection, web_collection


def _tokens(spark, sf_dir):
    return stats.field_token_arrays(web_collection(spark, sf_dir).docs)


@register("scan_docs", """
SELECT doc_id, title, text, url, lang FROM docs_web
""", ("docs_web",))
def scan_docs(spark, sf_dir):
    return finish(web_collection(spark, sf_dir).docs)


@register("scan_queries", """
SELECT query_id, text FROM queries_web UNION ALL SELECT query_id, text FROM queries_conv
""", ("queries_web", "queries_conv"))
def scan_queries(spark, sf_dir):
    return finish(web_collection(spark, sf_dir).queries.unionByName(
        conv_collection(spark, sf_dir).queries))


@register("scan_qrels", """
SELECT query_id, doc_id FROM qrels_web UNION ALL SELECT query_id, doc_id FROM qrels_conv
""", ("qrels_web", "qrels_conv"))
def scan_qrels(spark, sf_dir):
    return finish(web_collection(spark, sf_dir).qrels.unionByName(
        conv_collection(spark, sf_dir).qrels))


@register("tokenize_docs", """
SELECT doc_id, field, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens
FROM field_tokens_web
""", ("field_tokens_web",))
def tokenize_docs(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return finish(t.select("doc_id", "field", F.size("tokens").alias("n_tokens"),
                           F.array_join("tokens", " ").alias("tokens")))


@register("term_freq", "SELECT doc_id, field, term, tf FROM tf_web", ("tf_web",))
def term_freq(spark, sf_dir):
    return finish(stats.term_freq(_tokens(spark, sf_dir)))


@register("valid_tokens", """
SELECT doc_id, field, len(v) AS n_valid, array_to_string(v, ' ') AS tokens
FROM (SELECT doc_id, field, {valid} AS v FROM field_tokens_web)
""".replace("{valid}", __import__("ranklane.plans.oracle_views", fromlist=["valid"]).valid("tokens")),
    ("field_tokens_web",))
def valid_tokens(spark, sf_dir):
    from ranklane.functions.text import valid_tokens as vt
    t = _tokens(spark, sf_dir).select("doc_id", "field", vt("tokens").alias("v"))
    return finish(t.select("doc_id", "field", F.size("v").alias("n_valid"),
                           F.array_join("v", " ").alias("tokens")))


@register("valid_term_freq", "SELECT doc_id, field, term, tf FROM vtf_web", ("vtf_web",))
def valid_term_freq(spark, sf_dir):
    return finish(stats.valid_term_freq(_tokens(spark, sf_dir)))


@register("collection_stats", f"""
SELECT t.term, t.df, t.cf, c.dn, c.cn, c.vocab, {r6("c.avgdlen")} AS avgdlen
FROM term_stats_web t CROSS JOIN coll_stats_web c
""", ("term_stats_web", "coll_stats_web"))
def collection_stats(spark, sf_dir):
    ts, cs = stats.collection_stats(_tokens(spark, sf_dir))
    return finish(ts.select("term", "df", "cf", *[F.lit(cs[k]).alias(k) for k in
                                                 ("dn", "cn", "vocab", "avgdlen")]))


def web_bm25_topk(spark, sf_dir):
    c = web_collection(spark, sf_dir)
    k = qr.max_positive_count(qr.relevant_doc_counts(c.qrels)) + NEGATIVE_COUNT
    return retrieval.bm25_topk(c.docs, c.queries, k)


@register("bm25_topk", f"""
SELECT query_id, doc_id, {r6("score")} AS score, rank FROM bm25_topk_web
""", ("bm25_topk_web",))
def bm25_topk(spark, sf_dir):
    return finish(web_bm25_topk(spark, sf_dir))


@register("bm25_topk_conv", f"""
SELECT query_id, doc_id, {r6("score")} AS score, rank FROM bm25_topk_conv
""", ("bm25_topk_conv",))
def bm25_topk_conv(spark, sf_dir):
    c = conv_collection(spark, sf_dir)
    k = qr.max_positive_count(qr.relevant_doc_counts(c.qrels)) + NEGATIVE_COUNT
    return finish(retrieval.bm25_topk(c.docs, c.queries, k))


#: depth of the ranked lists of this report
LIST_DEPTH = 50


@register("rank_by_score", f"""
SELECT query_id, doc_id, {r6("score")} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM bm25_scores_web))
WHERE rank <= {LIST_DEPTH}
""", ("bm25_scores_web",))
def rank_by_score(spark, sf_dir):
    c = web_collection(spark, sf_dir)
    s = retrieval.bm25_scores(c.docs, c.queries, best=LIST_DEPTH).withColumn("score", F.round("score", 9))
    return finish(metrics.rank_by_score(s, k=LIST_DEPTH))


NDCG_SLICE_SQL = f"""
SELECT j.query_id, 'nDCG@{CUTOFF}' AS metric,
       {r6("CASE WHEN coalesce(i.idcg, 0) > 0 THEN coalesce(r.dcg, 0) / i.idcg ELSE 0.0 END")} AS value
FROM (SELECT DISTINCT query_id FROM qrels_web) j LEFT JOIN (SELECT t.query_id,
             sum(CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END / log2(t.rank + 1)) AS dcg
      FROM bm25_topk_web t LEFT JOIN qrels_web q ON q.query_id = t.query_id AND q.doc_id = t.doc_id
      WHERE t.rank <= {CUTOFF}
      GROUP BY t.query_id) r ON r.query_id = j.query_id
LEFT JOIN (SELECT query_id, sum(1.0 / log2(rn + 1)) AS idcg
           FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rn
                 FROM qrels_web) WHERE rn <= {CUTOFF} GROUP BY query_id) i
  ON i.query_id = j.query_id
"""


@register("ndcg_at_k", NDCG_SLICE_SQL, ("bm25_topk_web", "qrels_web"))
def ndcg_at_k(spark, sf_dir):
    c = web_collection(spark, sf_dir)
    run = web_bm25_topk(spark, sf_dir).where(F.col("rank") <= CUTOFF)
    judged = c.qrels.withColumn("relevance", F.lit(1))
    return finish(metrics.ndcg_at_k(run, judged, CUTOFF))


def entry_query(spark, sf_dir):
    """Flagship: BM25 top-k over web pages, scored by nDCG@10 per query."""
    return ndcg_at_k(spark, sf_dir)
