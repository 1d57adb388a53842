"""Ranking metrics as window/aggregate jobs.

A run is ``(…keys, query_id, doc_id, score)``; judgements are
``(…keys, query_id, doc_id, relevance)``. Every metric returns
``(…keys, query_id, metric, value)``; keys let many models and domains be
evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.constants import CUTOFF, MAP_REL_THRESHOLD


def rank_by_score(run: DataFrame, keys=(), k: int | None = None) -> DataFrame:
    """1-based rank by score desc within each list, doc_id breaks ties.
    Scores are compared at 1e-9 so ties do not depend on summation order.
    With ``k`` only the first ``k`` are kept, cut in each partition before the
    lists are shuffled."""
    w = Window.partitionBy(*keys, "query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
    ranked = run.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= F.lit(int(k)))


def _judged(run: DataFrame, qrels: DataFrame, keys) -> DataFrame:
    rel = qrels.select(*keys, "query_id", "doc_id", F.col("relevance").alias("__rel"))
    return run.join(rel, [*keys, "query_id", "doc_id"], "left").withColumn(
        "__rel", F.coalesce("__rel", F.lit(0)))


def _every_list(values: DataFrame, qrels: DataFrame, keys) -> DataFrame:
    """``values`` for every judged list, also one that the run has no row for
    (its value is 0)."""
    return qrels.select(*keys, "query_id").distinct().join(values, [*keys, "query_id"], "left")


def ndcg_at_k(run: DataFrame, qrels: DataFrame, k: int = CUTOFF, keys=(),
              gain: str = "linear") -> DataFrame:
    """nDCG@k per list (W9): DCG of the run's top k over the ideal DCG of the
    judged relevances; ideal 0 → 0. ``gain='exp'`` uses 2^rel − 1."""
    keys = list(keys)

    def g(c):
        return (F.pow(F.lit(2.0), c) - 1) if gain == "exp" else c.cast("double")

    ranked = rank_by_score(_judged(run, qrels, keys), keys).where(F.col("rank") <= k)
    dcg = ranked.groupBy(*keys, "query_id").agg(
        F.sum(g(F.col("__rel")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    wi = Window.partitionBy(*keys, "query_id").orderBy(F.col("relevance").desc(), F.col("doc_id"))
    ideal = (qrels.where(F.col("relevance") > 0)
             .withColumn("__r", F.row_number().over(wi)).where(F.col("__r") <= k)
             .groupBy(*keys, "query_id")
             .agg(F.sum(g(F.col("relevance")) / F.log2(F.col("__r") + 1)).alias("idcg")))
    out = _every_list(dcg, qrels, keys).join(ideal, [*keys, "query_id"], "left")
    val = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0))
    return out.select(*keys, "query_id", F.lit(f"nDCG@{k}").alias("metric"), val.alias("value"))


def err_at_k(run: DataFrame, qrels: DataFrame, k: int = CUTOFF, keys=()) -> DataFrame:
    """ERR@k (E2): r = (2^rel − 1) / 2^max_rel(query), running product of
    (1 − r) over higher ranks as exp(sum(ln(1 − r))) (W8, A17)."""
    keys = list(keys)
    max_rel = qrels.groupBy(*keys, "query_id").agg(F.max("relevance").alias("__max"))
    ranked = (rank_by_score(_judged(run, qrels, keys), keys).where(F.col("rank") <= k)
              .join(max_rel, [*keys, "query_id"], "left"))
    r = (F.pow(F.lit(2.0), F.col("__rel")) - 1) / F.pow(F.lit(2.0), F.coalesce("__max", F.lit(0)))
    w = (Window.partitionBy(*keys, "query_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("__r", r)
    p = F.coalesce(F.exp(F.sum(F.ln(F.lit(1.0) - F.col("__r"))).over(w)), F.lit(1.0))
    sums = (ranked.withColumn("__c", p * F.col("__r") / F.col("rank"))
            .groupBy(*keys, "query_id").agg(F.sum("__c").alias("value")))
    return _every_list(sums, qrels, keys).select(*keys, "query_id", F.lit(f"ERR@{k}").alias("metric"),
                                                 F.coalesce("value", F.lit(0.0)).alias("value"))


def map_metric(run: DataFrame, qrels: DataFrame, rel: int = MAP_REL_THRESHOLD, keys=()) -> DataFrame:
    """Average precision over the whole ranking (W10): precision at each
    relevant rank, averaged over all relevant judged docs; none → 0."""
    keys = list(keys)
    ranked = rank_by_score(_judged(run, qrels, keys), keys).withColumn(
        "__hit", (F.col("__rel") >= rel).cast("int"))
    w = (Window.partitionBy(*keys, "query_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, 0))
    prec = ranked.withColumn("__p", F.sum("__hit").over(w) / F.col("rank"))
    ap_sum = prec.groupBy(*keys, "query_id").agg(
        F.sum(F.when(F.col("__hit") == 1, F.col("__p")).otherwise(F.lit(0.0))).alias("__s"))
    n_rel = (qrels.where(F.col("relevance") >= rel)
             .groupBy(*keys, "query_id").agg(F.count("*").alias("__n")))
    out = _every_list(ap_sum, qrels, keys).join(n_rel, [*keys, "query_id"], "left")
    val = F.when(F.coalesce("__n", F.lit(0)) > 0, F.coalesce("__s", F.lit(0.0)) / F.col("__n")).otherwise(F.lit(0.0))
    return out.select(*keys, "query_id", F.lit("AP").alias("metric"), val.alias("value"))


METRICS = {"ndcg": ndcg_at_k, "err": err_at_k, "map": map_metric}


def evaluate(run: DataFrame, qrels: DataFrame, keys=(), metrics=("ndcg", "err", "map")) -> DataFrame:
    """Several metrics stacked."""
    out = None
    for m in metrics:
        part = METRICS[m](run, qrels, keys=keys)
        out = part if out is None else out.unionByName(part)
    return out


def with_all_row(per_query: DataFrame, keys=()) -> DataFrame:
    """Per-query values plus an ``all`` row holding their mean (S17/A18),
    as GROUPING SETS; a list with no queries gets no ``all`` row."""
    keys = list(keys)
    g = per_query.groupingSets(
        [[*keys, "metric", "query_id"], [*keys, "metric"]], *keys, "metric", "query_id"
    ).agg(F.avg("value").alias("value"), F.grouping("query_id").alias("__g"))
    return g.select(*keys, "metric",
                    F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col("query_id")).alias("query_id"),
                    "value")
