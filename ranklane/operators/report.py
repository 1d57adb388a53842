"""Reports over metric tables.

Metric tables are ``(model, domain_id, query_id, metric, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_ORDER = ["nDCG@10", "ERR@10", "AP"]


def per_domain_means(per_query: DataFrame) -> DataFrame:
    """Mean over the queries of each (model, domain, metric) — the ``all`` row."""
    return per_query.groupBy("model", "domain_id", "metric").agg(F.avg("value").alias("value"))


def mean_over_domains(per_query: DataFrame) -> DataFrame:
    """Unweighted mean over domains of the per-domain means."""
    return per_domain_means(per_query).groupBy("model", "metric").agg(
        F.avg("value").alias("value"), F.count("*").alias("n_domains"))


def report_grouping_sets(per_query: DataFrame) -> DataFrame:
    """Average rows and per-dataset rows in one aggregate (A20):
    GROUPING SETS ((model, metric), (domain_id, model, metric))."""
    d = per_domain_means(per_query)
    g = d.groupingSets([["model", "metric"], ["domain_id", "model", "metric"]],
                       "domain_id", "model", "metric").agg(
        F.avg("value").alias("value"), F.grouping("domain_id").alias("__g"))
    label = F.when(F.col("__g") == 1, F.lit("average")).otherwise(F.col("domain_id").cast("string"))
    return g.select("model", "metric", label.alias("dataset"), "value")


def markdown_lines(per_query: DataFrame, metrics=METRIC_ORDER) -> DataFrame:
    """Markdown table rows (S18): one line per (dataset, model) with the
    metrics at 4 decimals; datasets are 'average' and each domain."""
    r = report_grouping_sets(per_query)
    p = r.groupBy("dataset", "model").pivot("metric", list(metrics)).agg(F.first("value"))
    # 4 decimals by exact decimal rounding (half-up), independent of float formatting
    cells = [F.col(f"`{m}`").cast("decimal(38,6)").cast("decimal(38,4)").cast("string") for m in metrics]
    line = F.concat(F.lit("| "), F.col("model"), F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return p.select("dataset", "model", line.alias("line"))


def markdown_document(per_query: DataFrame, title: str = "Evaluation", metrics=METRIC_ORDER) -> DataFrame:
    """(pos, line): the whole report in order (S18, O6) — a title, then the
    average and one section per dataset, each with a header and its models
    sorted by name."""
    from ranklane.operators.ordering import global_position
    rows = markdown_lines(per_query, metrics)
    section = F.when(F.col("dataset") == "average", F.lit(-1)).otherwise(F.try_to_number("dataset", F.lit("9999999999")).cast("int"))
    head = F.array(*[F.struct(F.lit(k).alias("kind"), line.alias("line")) for k, line in enumerate((
        F.concat(F.lit("## "), F.col("dataset")), F.lit("| model | " + " | ".join(metrics) + " |"),
        F.lit("| --- |" + " --- |" * len(metrics))))])
    body = rows.select(section.alias("section"), F.lit(3).alias("kind"), "model", "line")
    heads = rows.select("dataset").distinct().select(section.alias("section"), F.inline(head)).select(
        "section", "kind", F.lit("").alias("model"), "line")
    first = per_query.sparkSession.createDataFrame([(-2, 0, "", f"# {title}")], body.schema)
    lines = first.unionByName(heads).unionByName(body)
    return global_position(lines, [F.col("section"), F.col("kind"), F.col("model")]).select("pos", "line")


def write_lines(document: DataFrame, path: str) -> None:
    """A (pos, line) document as text: ordered files, ordered inside."""
    (document.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("line").alias("value"))
     .write.mode("overwrite").text(path))


def weight_variance(weights: DataFrame) -> DataFrame:
    """Σ over features of the population variance of the domains' weights."""
    v = weights.groupBy("idx").agg(F.var_pop("w").alias("v"))
    return v.agg(F.sum("v").alias("total_variance"), F.count("*").alias("n_features"))


def meta_training_frame(domain_feats: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """Domain vectors (train + valid meta steps) joined with each domain's
    weights, pivoted to w0..w{n-1} (J16, U3)."""
    w = (weights.where(F.col("domain_id").isNotNull())
         .groupBy("domain_id").pivot("idx", list(range(n))).agg(F.first("w")))
    w = w.select("domain_id", *[F.col(f"`{i}`").alias(f"w{i}") for i in range(n)])
    x = domain_feats.where(F.col("meta_step").isin("train", "valid"))
    return x.join(w, "domain_id")
