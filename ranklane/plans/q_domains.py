"""Domain division (Entry C), rankers and metrics (Entry D) as registered queries.

The oracle-checked path groups queries with equal-frequency bins over one
query-level feature (the reference's 1-D clustering path) and scores with
the ``fixed_weights`` table, so the checks cover the data work and not a
learner; k-means and the trained rankers are rows-only keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions.constants import N_TOPICS, SEED, TRAIN_RATE, VALID_RATE, feature_index
from ranklane.operators import domains as dm
from ranklane.operators import ltr, metrics, report
from ranklane.operators.features import feature_names
from ranklane.plans.oracle_views import VIEWS, view
from ranklane.plans.q_features import FEATURES_VERSION, feature_table
from ranklane.plans.registry import finish, register

N_DOMAINS = 8
LTR = feature_index(N_TOPICS)["LtR"]
N_FEAT = len(feature_names())
QD_IDX = feature_index(N_TOPICS)["Q-D"]
BIN_FEATURE = feature_names().index("text_bm25")
N_TRAIN_DOM = int(N_DOMAINS * TRAIN_RATE)
N_VALID_DOM = int(N_DOMAINS * VALID_RATE)
SCOLS = [f"s{k}" for k in range(len(LTR))]


# ---- oracle views -------------------------------------------------------------------

view("qmean", "SELECT query_id, " + ", ".join(f"avg(f{i}) AS f{i}" for i in range(N_FEAT))
     + " FROM features_webf GROUP BY query_id")
view("qassign", f"""
SELECT query_id, CAST(ntile({N_DOMAINS}) OVER (ORDER BY round(f{BIN_FEATURE}, 9), query_id) - 1 AS INTEGER) AS domain_id
FROM qmean
""")
view("qsplit", f"""
SELECT query_id, domain_id,
       CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'valid' ELSE 'test' END AS step
FROM (SELECT *, greatest(1, floor(n * {TRAIN_RATE}::DOUBLE)) AS tr,
             least(floor(n * {VALID_RATE}::DOUBLE), n - greatest(1, floor(n * {TRAIN_RATE}::DOUBLE))) AS va
      FROM (SELECT query_id, domain_id,
                   row_number() OVER (PARTITION BY domain_id ORDER BY md5('{SEED}:' || query_id), query_id) AS rn,
                   count(*) OVER (PARTITION BY domain_id) AS n
            FROM qassign))
""")
view("dsplit", f"""
SELECT domain_id, CASE WHEN pos <= {N_TRAIN_DOM} THEN 'train'
                       WHEN pos <= {N_TRAIN_DOM + N_VALID_DOM} THEN 'valid' ELSE 'test' END AS meta_step
FROM (SELECT CAST(i AS INTEGER) AS domain_id,
             row_number() OVER (ORDER BY md5('{SEED}:' || CAST(i AS VARCHAR)), i) AS pos
      FROM range({N_DOMAINS}) t(i))
""")
view("divided", "SELECT ds.meta_step, qs.domain_id, qs.step, f.relevance, f.query_id, f.doc_id, "
     + ", ".join(f"f{i} AS s{k}" for k, i in enumerate(LTR)) + """
FROM features_webf f JOIN qsplit qs ON qs.query_id = f.query_id JOIN dsplit ds ON ds.domain_id = qs.domain_id
""")
view("fixed_weights", f"""
SELECT 'ideal' AS model, CAST(d AS INTEGER) AS domain_id, CAST(i AS INTEGER) AS idx,
       ((d * 37 + i * 11) % 17 - 8) / 16.0 AS w
FROM range({N_DOMAINS}) a(d), range({len(LTR)}) b(i)
UNION ALL
SELECT 'global' AS model, CAST(NULL AS INTEGER) AS domain_id, CAST(i AS INTEGER) AS idx,
       (({N_DOMAINS} * 37 + i * 11) % 17 - 8) / 16.0 AS w
FROM range({len(LTR)}) b(i)
""")
view("zlong", """
SELECT meta_step, domain_id, step, query_id, doc_id, relevance, idx,
       CASE WHEN sd IS NULL OR high - low <= 1e-9 * greatest(abs(low), abs(high)) THEN 0.0 ELSE (value - mu) / sd END AS z
FROM (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, min(value) OVER w AS low, max(value) OVER w AS high
      FROM (SELECT meta_step, domain_id, step, query_id, doc_id, relevance,
                   CAST(substr(col, 2) AS INTEGER) AS idx, value
            FROM (UNPIVOT (SELECT * FROM divided WHERE meta_step = 'test' AND step = 'test')
                  ON """ + ", ".join(SCOLS) + """ INTO NAME col VALUE value))
      WINDOW w AS (PARTITION BY domain_id, query_id, idx))
""")
view("scores", """
SELECT model, domain_id, query_id, doc_id, relevance, sum(w * z) AS score FROM (
  SELECT f.model, z.domain_id, z.query_id, z.doc_id, z.relevance, f.w, z.z
  FROM zlong z JOIN fixed_weights f ON f.domain_id = z.domain_id AND f.idx = z.idx
  UNION ALL
  SELECT f.model, z.domain_id, z.query_id, z.doc_id, z.relevance, f.w, z.z
  FROM zlong z JOIN fixed_weights f ON f.domain_id IS NULL AND f.idx = z.idx)
GROUP BY model, domain_id, query_id, doc_id, relevance
""")
view("ranked_scores", """
SELECT *, row_number() OVER (PARTITION BY model, domain_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
FROM scores
""")
view("m_ndcg", """
SELECT d.model, d.domain_id, d.query_id, 'nDCG@10' AS metric,
       CASE WHEN coalesce(i.idcg, 0) > 0 THEN d.dcg / i.idcg ELSE 0.0 END AS value
FROM (SELECT model, domain_id, query_id, sum(relevance / log2(rank + 1)) AS dcg
      FROM ranked_scores WHERE rank <= 10 GROUP BY model, domain_id, query_id) d
LEFT JOIN (SELECT model, domain_id, query_id, sum(relevance / log2(r + 1)) AS idcg
           FROM (SELECT model, domain_id, query_id, relevance,
                        row_number() OVER (PARTITION BY model, domain_id, query_id ORDER BY relevance DESC, doc_id) AS r
                 FROM scores WHERE relevance > 0) WHERE r <= 10
           GROUP BY model, domain_id, query_id) i
  ON i.model = d.model AND i.domain_id = d.domain_id AND i.query_id = d.query_id
""")
view("m_err", """
SELECT model, domain_id, query_id, 'ERR@10' AS metric, sum(p * r / rank) AS value
FROM (SELECT *, coalesce(exp(sum(ln(1.0 - r)) OVER (PARTITION BY model, domain_id, query_id ORDER BY rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS p
      FROM (SELECT s.*, (pow(2.0, s.relevance) - 1) / pow(2.0, coalesce(mx.mr, 0)) AS r
            FROM ranked_scores s
            LEFT JOIN (SELECT model, domain_id, query_id, max(relevance) AS mr FROM scores
                       GROUP BY model, domain_id, query_id) mx
              ON mx.model = s.model AND mx.domain_id = s.domain_id AND mx.query_id = s.query_id
            WHERE s.rank <= 10))
GROUP BY model, domain_id, query_id
""")
view("m_map", """
SELECT a.model, a.domain_id, a.query_id, 'AP' AS metric,
       CASE WHEN coalesce(n.nrel, 0) > 0 THEN a.s / n.nrel ELSE 0.0 END AS value
FROM (SELECT model, domain_id, query_id, sum(CASE WHEN hit = 1 THEN prec ELSE 0.0 END) AS s
      FROM (SELECT *, sum(hit) OVER (PARTITION BY model, domain_id, query_id ORDER BY rank
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rank AS prec
            FROM (SELECT *, CASE WHEN relevance >= 1 THEN 1 ELSE 0 END AS hit FROM ranked_scores))
      GROUP BY model, domain_id, query_id) a
LEFT JOIN (SELECT model, domain_id, query_id, count(*) AS nrel FROM scores WHERE relevance >= 1
           GROUP BY model, domain_id, query_id) n
  ON n.model = a.model AND n.domain_id = a.domain_id AND n.query_id = a.query_id
""")
view("m_all", "SELECT * FROM m_ndcg UNION ALL SELECT * FROM m_err UNION ALL SELECT * FROM m_map")
view("m_with_all", """
SELECT model, domain_id, metric, CASE WHEN grouping(query_id) = 1 THEN 'all' ELSE query_id END AS query_id,
       avg(value) AS value
FROM m_all GROUP BY GROUPING SETS ((model, domain_id, metric, query_id), (model, domain_id, metric))
""")
view("dom_means", """
SELECT model, domain_id, metric, value FROM m_with_all WHERE query_id = 'all'
""")

# the same over the lists of every domain and step
view("zlong_all", VIEWS["zlong"].replace("WHERE meta_step = 'test' AND step = 'test'", ""))
view("scores_all", VIEWS["scores"].replace("zlong", "zlong_all"))
view("ranked_scores_all", VIEWS["ranked_scores"].replace("FROM scores", "FROM scores_all"))
for _m in ("m_err", "m_map"):
    view(f"{_m}_all", VIEWS[_m].replace("ranked_scores", "ranked_scores_all").replace("FROM scores", "FROM scores_all"))


# ---- Spark side ---------------------------------------------------------------------

def _feats(spark, sf_dir):
    return feature_table(spark, sf_dir)


def _assign(spark, sf_dir):
    qm = dm.query_mean_features(_feats(spark, sf_dir))
    return dm.equal_freq_domains(qm.select("query_id", F.col(f"f{BIN_FEATURE}").alias("value")), N_DOMAINS)


#: raise with any change of what a stage computes
DIVIDED_VERSION = RANKERS_VERSION = 1


def _stage_table(spark, sf_dir, name, version, build):
    """A stage's result, computed once per state of the input and version."""
    from ranklane.session import checkpoint_dir
    from ranklane.sources.formats import has_success, materialize, stage_path
    path = stage_path(spark, checkpoint_dir(spark), name, version, [f"{sf_dir.rstrip('/')}/pages.parquet"],
                      features=FEATURES_VERSION, domains=N_DOMAINS)
    if has_success(spark, path):
        return spark.read.parquet(path)
    return materialize(build(), path)


def _divided(spark, sf_dir):
    def build():
        qsplit = dm.split_queries(_assign(spark, sf_dir))
        return dm.divide_dataset(_feats(spark, sf_dir), qsplit, dm.split_domains(spark, N_DOMAINS), LTR)
    return _stage_table(spark, sf_dir, "divided", DIVIDED_VERSION, build)


def fixed_weights(spark):
    """Deterministic stand-in for trained rankers: 'ideal' per domain and one
    'global' model (NULL domain); w = ((d·37 + i·11) mod 17 − 8) / 16."""
    n = len(LTR)
    ids = spark.range(N_DOMAINS * n)
    d, i = (F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    own = ids.select(F.lit("ideal").alias("model"), d.alias("domain_id"), i.alias("idx"),
                     (((d * 37 + i * 11) % 17 - 8) / 16.0).alias("w"))
    g = spark.range(n).select(F.lit("global").alias("model"), F.lit(None).cast("int").alias("domain_id"),
                              F.col("id").cast("int").alias("idx"),
                              (((F.lit(N_DOMAINS) * 37 + F.col("id").cast("int") * 11) % 17 - 8) / 16.0).alias("w"))
    return own.unionByName(g)


def _all_long(spark, sf_dir):
    long = ltr.to_long(_divided(spark, sf_dir), ["meta_step", "domain_id", "step"])
    from ranklane.operators.stats import zscore_per_query
    return zscore_per_query(long, keys=("domain_id", "query_id")).drop("value").withColumnRenamed("z", "value")


def _test_rows(spark, sf_dir):
    d = _divided(spark, sf_dir).where((F.col("meta_step") == "test") & (F.col("step") == "test"))
    return ltr.zscore_wide(d, ["domain_id"])


def _scores(spark, sf_dir, weights=None):
    return ltr.score_wide(_test_rows(spark, sf_dir), fixed_weights(spark) if weights is None else weights)


def _all_scores(spark, sf_dir):
    """Every model on the lists of every domain and step."""
    return ltr.score_wide(ltr.zscore_wide(_divided(spark, sf_dir), ["domain_id"]), fixed_weights(spark))


def _metrics(spark, sf_dir, weights=None):
    # three metrics read the scores: computed once
    s = _scores(spark, sf_dir, weights).checkpoint()
    q = s.select("model", "domain_id", "query_id", "doc_id", "relevance")
    return metrics.evaluate(s, q, keys=["model", "domain_id"])


@register("query_mean_features", "SELECT * FROM qmean", ("qmean",))
def query_mean_features(spark, sf_dir):
    return finish(dm.query_mean_features(_feats(spark, sf_dir)))


QD_SCALE_SQL = "SELECT query_id, " + ", ".join(
    f"(f{i} - avg(f{i}) OVER ()) / CASE WHEN max(f{i}) OVER () - min(f{i}) OVER () <= "
    f"1e-9 * greatest(abs(max(f{i}) OVER ()), abs(min(f{i}) OVER ())) THEN 1.0 "
    f"ELSE stddev_pop(f{i}) OVER () END AS f{i}" for i in QD_IDX) + " FROM qmean"


@register("standard_scale", QD_SCALE_SQL, ("qmean",))
def standard_scale(spark, sf_dir):
    from ranklane.operators.stats import standard_scale as ss
    qm = dm.query_mean_features(_feats(spark, sf_dir))
    return finish(ss(qm, "query_id", [f"f{i}" for i in QD_IDX]))


@register("equal_freq_domains", "SELECT query_id, domain_id FROM qassign", ("qassign",))
def equal_freq_domains(spark, sf_dir):
    return finish(_assign(spark, sf_dir))


@register("random_domains", f"""
SELECT query_id, CAST(CAST(('0x' || substr(md5('{SEED}:' || query_id), 1, 8)) AS BIGINT) % {N_DOMAINS} AS INTEGER) AS domain_id
FROM qmean
""", ("qmean",))
def random_domains(spark, sf_dir):
    qm = dm.query_mean_features(_feats(spark, sf_dir))
    return finish(dm.random_domains(qm, N_DOMAINS))


@register("kmeans_domains")
def kmeans_domains(spark, sf_dir):
    from ranklane.operators.stats import standard_scale as ss
    # the scaling and the fits read the means: computed once
    cols = [f"f{i}" for i in QD_IDX]
    qm = dm.query_mean_features(_feats(spark, sf_dir)).select("query_id", *cols).persist()
    scaled = ss(qm, "query_id", cols)
    return finish(dm.kmeans_domains(scaled, N_DOMAINS))


@register("domain_members", """
SELECT domain_id, query_id FROM qassign
""", ("qassign",))
def domain_members(spark, sf_dir):
    return finish(dm.domain_members(_assign(spark, sf_dir)))


@register("split_queries", "SELECT query_id, domain_id, step FROM qsplit", ("qsplit",))
def split_queries(spark, sf_dir):
    return finish(dm.split_queries(_assign(spark, sf_dir)))


@register("split_domains", """
SELECT d.domain_id, d.meta_step, coalesce(a.n, 0) AS n_queries
FROM dsplit d LEFT JOIN (SELECT domain_id, count(*) AS n FROM qassign GROUP BY domain_id) a
  ON a.domain_id = d.domain_id
""", ("dsplit", "qassign"))
def split_domains(spark, sf_dir):
    """Step of every domain id (those without queries included) with the
    number of queries the dataset puts in it."""
    counts = _assign(spark, sf_dir).groupBy("domain_id").agg(F.count("*").alias("n_queries"))
    d = dm.split_domains(spark, N_DOMAINS).join(counts, "domain_id", "left")
    return finish(d.select("domain_id", "meta_step", F.coalesce("n_queries", F.lit(0)).alias("n_queries")))


@register("divide_dataset", "SELECT * FROM divided", ("divided",))
def divide_dataset(spark, sf_dir):
    return finish(_divided(spark, sf_dir))


@register("global_dataset", """
SELECT meta_step, step, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries,
       sum(relevance) AS n_positive
FROM divided GROUP BY meta_step, step
""", ("divided",))
def global_dataset(spark, sf_dir):
    g = dm.global_dataset(_divided(spark, sf_dir))
    return finish(g.groupBy("meta_step", "step").agg(
        F.count("*").alias("n_rows"), F.count_distinct("query_id").alias("n_queries"),
        F.sum("relevance").alias("n_positive")))


def _dom_sql(filter_sql: str) -> str:
    return ("SELECT meta_step, domain_id, " + ", ".join(f"avg({c}) AS {c}" for c in SCOLS)
            + " FROM (SELECT meta_step, domain_id, query_id, " + ", ".join(f"avg({c}) AS {c}" for c in SCOLS)
            + f" FROM divided {filter_sql} GROUP BY meta_step, domain_id, query_id) GROUP BY meta_step, domain_id")


@register("domain_features_all", _dom_sql(""), ("divided",))
def domain_features_all(spark, sf_dir):
    return finish(dm.domain_vectors("all_rows", _divided(spark, sf_dir)))


@register("domain_features_positive",
          _dom_sql("WHERE relevance > 0 AND step IN ('train', 'valid')"), ("divided",))
def domain_features_positive(spark, sf_dir):
    return finish(dm.domain_vectors("positive_rows", _divided(spark, sf_dir)))


@register("zscore_per_query", "SELECT domain_id, query_id, doc_id, idx, z FROM zlong_all", ("zlong_all",))
def zscore_per_query(spark, sf_dir):
    z = _all_long(spark, sf_dir)
    return finish(z.select("domain_id", "query_id", "doc_id", "idx", F.col("value").alias("z")))


@register("score_models", "SELECT model, domain_id, query_id, doc_id, score FROM scores_all", ("scores_all",))
def score_models(spark, sf_dir):
    return finish(_all_scores(spark, sf_dir).select("model", "domain_id", "query_id", "doc_id", "score"))


@register("score_qrel_join", """
SELECT s.model, s.domain_id, s.query_id, s.doc_id, d.relevance, s.score
FROM scores_all s JOIN (SELECT DISTINCT domain_id, query_id, doc_id, relevance FROM divided) d
  ON d.domain_id = s.domain_id AND d.query_id = s.query_id AND d.doc_id = s.doc_id
""", ("scores_all", "divided"))
def score_qrel_join(spark, sf_dir):
    s = _all_scores(spark, sf_dir).select("model", "domain_id", "query_id", "doc_id", "score")
    q = _divided(spark, sf_dir).select("domain_id", "query_id", "doc_id", "relevance").distinct()
    return finish(s.join(q, ["domain_id", "query_id", "doc_id"])
                  .select("model", "domain_id", "query_id", "doc_id", "relevance", "score"))


@register("err_at_k", "SELECT * FROM m_err_all", ("m_err_all",))
def err_at_k(spark, sf_dir):
    s = _all_scores(spark, sf_dir)
    q = s.select("model", "domain_id", "query_id", "doc_id", "relevance")
    return finish(metrics.err_at_k(s, q, keys=["model", "domain_id"]))


@register("map_metric", "SELECT * FROM m_map_all", ("m_map_all",))
def map_metric(spark, sf_dir):
    s = _all_scores(spark, sf_dir)
    q = s.select("model", "domain_id", "query_id", "doc_id", "relevance")
    return finish(metrics.map_metric(s, q, keys=["model", "domain_id"]))


@register("compare_models", "SELECT * FROM m_all", ("m_all",))
def compare_models(spark, sf_dir):
    return finish(_metrics(spark, sf_dir))


@register("metric_with_all_row", "SELECT * FROM m_with_all", ("m_with_all",))
def metric_with_all_row(spark, sf_dir):
    return finish(metrics.with_all_row(_metrics(spark, sf_dir), keys=["model", "domain_id"]))


@register("mean_over_domains", """
SELECT model, metric, avg(value) AS value, count(*) AS n_domains FROM dom_means GROUP BY model, metric
""", ("dom_means",))
def mean_over_domains(spark, sf_dir):
    return finish(report.mean_over_domains(_metrics(spark, sf_dir)))


@register("report_grouping_sets", """
SELECT model, metric, CASE WHEN grouping(domain_id) = 1 THEN 'average' ELSE CAST(domain_id AS VARCHAR) END AS dataset,
       avg(value) AS value
FROM dom_means GROUP BY GROUPING SETS ((model, metric), (domain_id, model, metric))
""", ("dom_means",))
def report_grouping_sets(spark, sf_dir):
    return finish(report.report_grouping_sets(_metrics(spark, sf_dir)))


@register("weight_variance", """
SELECT sum(v) AS total_variance, count(*) AS n_features
FROM (SELECT idx, var_pop(w) AS v FROM fixed_weights
      WHERE domain_id IS NOT NULL AND domain_id IN (SELECT domain_id FROM divided) GROUP BY idx)
""", ("fixed_weights", "divided"))
def weight_variance(spark, sf_dir):
    w = fixed_weights(spark).where(F.col("domain_id").isNotNull())
    # the weights of the domains that actually hold queries in this dataset
    doms = _divided(spark, sf_dir).select("domain_id").distinct()
    return finish(report.weight_variance(w.join(doms, "domain_id", "left_semi")))


N_RESTARTS = 4
view("restart_weights", f"""
SELECT 'global' AS model, CAST(r AS INTEGER) AS restart, CAST(i AS INTEGER) AS idx,
       (((r + 1) * 37 + i * 11) % 17 - 8) / 16.0 AS w
FROM range({N_RESTARTS}) a(r), range({len(LTR)}) b(i)
""")
view("restart_evals", """
SELECT model, restart, query_id, CASE WHEN coalesce(i.idcg, 0) > 0 THEN d.dcg / i.idcg ELSE 0.0 END AS value
FROM (SELECT model, restart, query_id, sum(relevance / log2(rank + 1)) AS dcg FROM (
        SELECT *, row_number() OVER (PARTITION BY model, restart, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM (SELECT w.model, w.restart, v.query_id, v.doc_id, v.relevance, sum(w.w * v.z) AS score
              FROM vlong v JOIN restart_weights w ON w.idx = v.idx
              GROUP BY w.model, w.restart, v.query_id, v.doc_id, v.relevance))
      WHERE rank <= 10 GROUP BY model, restart, query_id) d
JOIN (SELECT query_id, sum(relevance / log2(r + 1)) AS idcg
      FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r
            FROM (SELECT DISTINCT query_id, doc_id, relevance FROM vlong) WHERE relevance > 0)
      WHERE r <= 10 GROUP BY query_id) i USING (query_id)
""".replace("JOIN (SELECT query_id, sum", "LEFT JOIN (SELECT query_id, sum").replace(
    "FROM (SELECT model, restart, query_id, CASE", "FROM (SELECT model, restart, query_id, CASE"))
view("vlong", """
SELECT query_id, doc_id, relevance, idx,
       CASE WHEN sd IS NULL OR high - low <= 1e-9 * greatest(abs(low), abs(high)) THEN 0.0 ELSE (value - mu) / sd END AS z
FROM (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, min(value) OVER w AS low, max(value) OVER w AS high
      FROM (SELECT query_id, doc_id, relevance, CAST(substr(col, 2) AS INTEGER) AS idx, value
            FROM (UNPIVOT (SELECT * FROM divided WHERE step = 'valid') ON """ + ", ".join(SCOLS) + """
                  INTO NAME col VALUE value))
      WINDOW w AS (PARTITION BY query_id, idx))
""")


def restart_weights(spark):
    n = len(LTR)
    ids = spark.range(N_RESTARTS * n)
    r, i = (F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    return ids.select(F.lit("global").alias("model"), r.alias("restart"), i.alias("idx"),
                      ((((r + 1) * 37 + i * 11) % 17 - 8) / 16.0).alias("w"))


def _restart_evals(spark, sf_dir):
    """NDCG@10 on the valid step of every domain, for each restart's global
    weights (A21 input); selection is on valid, not test."""
    d = _divided(spark, sf_dir).where(F.col("step") == "valid")
    rw = restart_weights(spark).withColumn("model", F.concat_ws("/", "model", "restart")).withColumn(
        "domain_id", F.lit(None).cast("int"))
    s = ltr.score_wide(ltr.zscore_wide(d, []), rw, keys=())
    s = s.withColumn("restart", F.split_part("model", F.lit("/"), F.lit(2)).cast("int")).withColumn(
        "model", F.split_part("model", F.lit("/"), F.lit(1)))
    q = d.select("query_id", "doc_id", "relevance").distinct()
    nd = metrics.ndcg_at_k(s, _qrels_for(s, q), keys=["model", "restart"])
    return nd


def _qrels_for(scores, qrels):
    """Judgements repeated for each (model, restart) key of the scores."""
    keys = scores.select("model", "restart", "query_id").distinct()
    return keys.join(qrels, "query_id")


@register("best_restart", """
SELECT model, max_by(restart, (round(score, 9), -restart)) AS restart, max(score) AS score
FROM (SELECT model, restart, avg(value) AS score FROM restart_evals GROUP BY model, restart)
GROUP BY model
""", ("restart_evals",))
def best_restart(spark, sf_dir):
    ev = _restart_evals(spark, sf_dir)
    per = ev.groupBy("model", "restart").agg(F.avg("value").alias("score"))
    return finish(ltr.best_restart(per))


@register("meta_training_frame", "SELECT d.meta_step, d.domain_id, "
          + ", ".join(f"d.{c}" for c in SCOLS) + ", "
          + ", ".join(f"max(CASE WHEN w.idx = {k} THEN w.w END) AS w{k}" for k in range(len(LTR)))
          + """ FROM (""" + _dom_sql("") + """) d JOIN fixed_weights w ON w.domain_id = d.domain_id
WHERE d.meta_step IN ('train', 'valid')
GROUP BY d.meta_step, d.domain_id, """ + ", ".join(f"d.{c}" for c in SCOLS), ("divided", "fixed_weights"))
def meta_training_frame(spark, sf_dir):
    return finish(report.meta_training_frame(dm.domain_features(_divided(spark, sf_dir)),
                                             fixed_weights(spark), len(LTR)))


MARKDOWN_SQL = """
SELECT dataset, model, '| ' || model || ' | ' || CAST(CAST(CAST(n AS DECIMAL(38,6)) AS DECIMAL(38,4)) AS VARCHAR)
       || ' | ' || CAST(CAST(CAST(e AS DECIMAL(38,6)) AS DECIMAL(38,4)) AS VARCHAR)
       || ' | ' || CAST(CAST(CAST(a AS DECIMAL(38,6)) AS DECIMAL(38,4)) AS VARCHAR) || ' |' AS line
FROM (SELECT dataset, model, max(CASE WHEN metric = 'nDCG@10' THEN value END) AS n,
             max(CASE WHEN metric = 'ERR@10' THEN value END) AS e,
             max(CASE WHEN metric = 'AP' THEN value END) AS a
      FROM (SELECT model, metric, CASE WHEN grouping(domain_id) = 1 THEN 'average'
                                       ELSE CAST(domain_id AS VARCHAR) END AS dataset, avg(value) AS value
            FROM dom_means GROUP BY GROUPING SETS ((model, metric), (domain_id, model, metric)))
      GROUP BY dataset, model)
"""


@register("markdown_report", MARKDOWN_SQL, ("dom_means",))
def markdown_report(spark, sf_dir):
    return finish(report.markdown_lines(_metrics(spark, sf_dir)))


@register("markdown_document", f"""
SELECT row_number() OVER (ORDER BY section, kind, model) AS pos, line FROM (
  SELECT -2 AS section, 0 AS kind, '' AS model, '# Evaluation' AS line
  UNION ALL SELECT DISTINCT CASE WHEN dataset = 'average' THEN -1 ELSE CAST(dataset AS INTEGER) END, k, '',
         CASE k WHEN 0 THEN '## ' || dataset WHEN 1 THEN '| model | nDCG@10 | ERR@10 | AP |'
                ELSE '| --- | --- | --- | --- |' END
  FROM ({MARKDOWN_SQL}), range(3) h(k)
  UNION ALL SELECT CASE WHEN dataset = 'average' THEN -1 ELSE CAST(dataset AS INTEGER) END, 3, model, line
  FROM ({MARKDOWN_SQL}))
""", ("dom_means",))
def markdown_document(spark, sf_dir):
    """The report as a document, also written as ordered text files."""
    from ranklane.session import scratch_path
    doc = report.markdown_document(_metrics(spark, sf_dir))
    report.write_lines(doc, scratch_path(spark, "report"))
    return finish(doc)


def _valid_ndcg(rows, weights, keys):
    """Mean NDCG@10 of every restart on valid lists: (…keys, restart, score)."""
    w = weights.select(F.concat(F.lit("r"), F.col("restart").cast("string")).alias("model"),
                       F.col("domain_id") if keys else F.lit(None).cast("int").alias("domain_id"), "idx", "w")
    s = ltr.score_wide(rows, w, keys=keys).checkpoint()
    nd = metrics.ndcg_at_k(s, s.select("model", *keys, "query_id", "doc_id", "relevance"), keys=["model", *keys])
    return (nd.groupBy("model", *keys).agg(F.avg("value").alias("score"))
            .select(*keys, F.expr("int(substring(model, 2))").alias("restart"), "score"))


def trained_domain_rankers(spark, sf_dir):
    """(domain_id, restart, idx, w, objective): coordinate ascent per domain on
    its train lists, 16 restarts; the restart that is best on the domain's
    valid lists stays (on the training objective where it has none)."""
    def build():
        d = _divided(spark, sf_dir)
        w = ltr.coordinate_ascent(ltr.zscore_wide(d.where(F.col("step") == "train"), ["domain_id"]),
                                  ["domain_id"], len(LTR), restarts=16).checkpoint()
        on_valid = _valid_ndcg(ltr.zscore_wide(d.where(F.col("step") == "valid"), ["domain_id"]), w, ["domain_id"])
        per = (w.select("domain_id", "restart", "objective").distinct()
               .join(on_valid, ["domain_id", "restart"], "left"))
        best = per.groupBy("domain_id").agg(F.max_by("restart", F.struct(
            F.round(F.coalesce("score", F.lit(-1.0)), 9), F.round("objective", 9), -F.col("restart"))).alias("restart"))
        return w.join(best, ["domain_id", "restart"])
    return _stage_table(spark, sf_dir, "domain-rankers", RANKERS_VERSION, build)


def trained_global_ranker(spark, sf_dir):
    """(restart, idx, w): 16 single-restart fits on all train lists; the best on
    the valid lists stays (on the training objective without any)."""
    def build():
        d = _divided(spark, sf_dir)
        rows = ltr.zscore_wide(d.where(F.col("step") == "train").withColumn("model", F.lit("global")), ["model"])
        w = ltr.coordinate_ascent(rows, ["model"], len(LTR), restarts=16).checkpoint()
        on_valid = _valid_ndcg(ltr.zscore_wide(d.where(F.col("step") == "valid"), []), w, [])
        per = w.select("restart", "objective").distinct().join(on_valid, "restart", "left").select(
            F.lit("global").alias("model"), "restart",
            F.struct(F.round(F.coalesce("score", F.lit(-1.0)), 9).alias("v"), F.round("objective", 9).alias("o")).alias("s"))
        best = per.groupBy("model").agg(F.max_by("restart", F.struct("s", -F.col("restart"))).alias("restart"))
        return w.join(best, "restart").select("restart", "idx", "w")
    return _stage_table(spark, sf_dir, "global-ranker", RANKERS_VERSION, build)


@register("train_domain_rankers")
def train_domain_rankers(spark, sf_dir):
    return finish(trained_domain_rankers(spark, sf_dir))


@register("train_global_ranker")
def train_global_ranker(spark, sf_dir):
    return finish(trained_global_ranker(spark, sf_dir))


@register("trained_weight_variance")
def trained_weight_variance(spark, sf_dir):
    """Spread of the trained rankers' weights over the domains."""
    return finish(report.weight_variance(trained_domain_rankers(spark, sf_dir)))
