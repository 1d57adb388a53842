"""Relevance-judgement operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_docs_by_lang(doc_lang: DataFrame, labels: list[str]) -> DataFrame:
    """Ids of documents whose title **and** text language are targets."""
    return (doc_lang.where(F.col("title_language").isin(*labels) & F.col("text_language").isin(*labels))
            .select("doc_id").distinct())


def filter_queries_by_lang(query_lang: DataFrame, labels: list[str]) -> DataFrame:
    """Ids of queries whose language is a target."""
    return query_lang.where(F.col("text_language").isin(*labels)).select("query_id").distinct()


def filter_qrels(qrels: DataFrame, kept_queries: DataFrame, kept_docs: DataFrame) -> DataFrame:
    """Qrels whose query and document were both kept (J1, double left-semi)."""
    return (qrels.join(kept_queries.select("query_id"), "query_id", "left_semi")
            .join(kept_docs.select("doc_id"), "doc_id", "left_semi")
            .select("query_id", "doc_id").distinct())


def check_nonempty(df: DataFrame, what: str) -> DataFrame:
    """The reference refuses to go on with an empty kept set; so do we
    (a one-row probe, not a count)."""
    if not df.take(1):
        raise ValueError(f"no {what} left after filtering")
    return df


def relevant_doc_counts(qrels: DataFrame) -> DataFrame:
    """(query_id, n_pos) — distinct relevant documents per query."""
    return qrels.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_pos"))


def relevant_docs(qrels: DataFrame) -> DataFrame:
    """The relevant documents of each query, one row per member (A1): a query
    with very many is no oversized row."""
    return qrels.select("query_id", "doc_id").distinct()


def positive_count_hist(counts: DataFrame) -> DataFrame:
    """Histogram: number of queries per positive count (A2)."""
    return counts.groupBy("n_pos").agg(F.count("*").alias("n_queries"))


def max_positive_count(counts: DataFrame) -> int:
    """Largest positive count, 0 when there is none (bounded scalar)."""
    row = counts.agg(F.coalesce(F.max("n_pos"), F.lit(0)).alias("m")).first()
    return int(row["m"])


def queries_with_positives(qrels: DataFrame, kept_queries: DataFrame) -> DataFrame:
    """Queries that have a relevant doc and were kept."""
    return qrels.select("query_id").intersect(kept_queries.select("query_id"))


def query_lookup(ids: DataFrame, queries: DataFrame) -> DataFrame:
    """Left lookup of the query text, default '' (J3)."""
    return ids.join(queries.select("query_id", "text"), "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit("")).alias("text"))


def doc_lookup(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Inner equi-join of wanted ids with the documents; missing ids drop."""
    return ids.select("doc_id").distinct().join(docs, "doc_id")


def nonempty_queries(queries: DataFrame) -> DataFrame:
    """Drop queries whose text is NULL or empty."""
    return queries.where(F.coalesce(F.col("text"), F.lit("")) != "")


def negatives_topn(ranked: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """First ``n`` ranked docs that are not positives, in rank order (J7 + W2).
    The reference checks the limit after appending, so ``n = 0`` still yields one."""
    neg = ranked.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return (neg.withColumn("__n", F.row_number().over(w))
            .where(F.col("__n") <= F.lit(max(int(n), 1))).drop("__n"))


def attach_qrels(ranked: DataFrame, qrels: DataFrame, n_negatives: int) -> DataFrame:
    """Judgements (U2): every positive of a ranked query (relevance 1, even if
    not retrieved) plus its first negatives (relevance 0)."""
    ranked_q = ranked.select("query_id").distinct()
    pos = (qrels.select("query_id", "doc_id").distinct()
           .join(ranked_q, "query_id", "left_semi")
           .withColumn("relevance", F.lit(1)))
    neg = (negatives_topn(ranked, qrels, n_negatives)
           .select("query_id", "doc_id", F.lit(0).alias("relevance")))
    return pos.unionByName(neg)


def distinct_judged_ids(judgements: DataFrame):
    """(doc ids, query ids) of the judgements (A3)."""
    return judgements.select("doc_id").distinct(), judgements.select("query_id").distinct()
