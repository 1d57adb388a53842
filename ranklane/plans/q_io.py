"""Sources and sinks as registered round trips.

Each writer targets a fresh folder under the shared checkpoint folder and the
query returns what was read back, so the check covers write and read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.functions.text import hex_key
from ranklane.operators import stats
from ranklane.plans.q_domains import LTR, SCOLS, _divided, fixed_weights
from ranklane.plans.q_features import feature_table
from ranklane.plans.q_judge import _stage, judgement_table
from ranklane.plans.registry import finish, register
from ranklane.session import scratch_path
from ranklane.sources import formats as io
from ranklane.sources.tables import conv_collection, read_table, web_collection

JUDG_SCHEMA = "query_id string, doc_id string, relevance int"


@register("jsonl_roundtrip", "SELECT query_id, doc_id, relevance FROM judgements_webf", ("judgements_webf",))
def jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "judgements-jsonl")
    io.write_jsonl(judgement_table(spark, sf_dir), path)
    return finish(io.read_jsonl(spark, path, JUDG_SCHEMA))


@register("id_list_roundtrip", "SELECT DISTINCT doc_id FROM judgements_webf", ("judgements_webf",))
def id_list_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "doc-ids")
    # every judged row's id (repeats included), padded like hand-edited lines
    ids = judgement_table(spark, sf_dir).select(F.concat(F.lit("  "), "doc_id", F.lit(" ")).alias("doc_id"))
    io.write_id_list(ids, path, "doc_id")
    return finish(io.load_id_set(spark, path, "doc_id"))


@register("query_store", """
SELECT query_id, text FROM (
  SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY src DESC) AS r
  FROM (SELECT query_id, text, 0 AS src FROM queries_web UNION ALL SELECT query_id, text, 1 AS src FROM queries_conv))
WHERE r = 1
""", ("queries_web", "queries_conv"))
def query_store(spark, sf_dir):
    """Keyed store over both collections loaded in order (web, then
    conversations): an id present in both keeps the later row."""
    q = (web_collection(spark, sf_dir).queries.withColumn("src", F.lit(0))
         .unionByName(conv_collection(spark, sf_dir).queries.withColumn("src", F.lit(1))))
    st = io.save_store(q, scratch_path(spark, "query-store"), "query_id", order=F.col("src"))
    return finish(st.select("query_id", "text"))


TOPIC_TSV_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("language", T.StringType()),
    T.StructField("language_confidence", T.DoubleType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("topic_main", T.StringType()),
])
TOPIC_TSV_SQL = r"""
SELECT doc_id, lang AS language, (doc_id % 10) / 10.0 AS language_confidence,
       regexp_replace(string_split(text, chr(10))[1], '[\t\r]', ' ', 'g') AS title,
       regexp_replace(array_to_string(string_split(text, chr(10))[2:], ' '), '[\t\r]', ' ', 'g') AS description,
       source AS topic_main
FROM documents
"""


def topic_tsv(spark, sf_dir):
    """The topic-training TSV built from ``documents``: the first line is the
    title, all others the description (tabs/newlines → blanks)."""
    d = read_table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    flat = lambda c: F.regexp_replace(c, r"[\t\r]", " ")
    return d.select("doc_id", F.col("lang").alias("language"),
                    ((F.col("doc_id") % 10) / 10.0).alias("language_confidence"),
                    flat(F.get(lines, 0)).alias("title"), flat(rest).alias("description"),
                    F.col("source").alias("topic_main"))


def topic_tsv_path(spark, sf_dir):
    path = scratch_path(spark, "topics-tsv")
    io.write_tsv(topic_tsv(spark, sf_dir), path)
    return path


@register("tsv_scan", TOPIC_TSV_SQL)
def tsv_scan(spark, sf_dir):
    return finish(io.read_tsv(spark, topic_tsv_path(spark, sf_dir), TOPIC_TSV_SCHEMA))


@register("feature_csv_roundtrip", "SELECT * FROM features_webf", ("features_webf",))
def feature_csv_roundtrip(spark, sf_dir):
    from ranklane.operators.features import feature_names, to_vector
    n = len(feature_names())
    path = scratch_path(spark, "features-csv")
    io.write_vector_csv(to_vector(feature_table(spark, sf_dir), n), path,
                        ["relevance", "query_id", "doc_id"], n=n)
    back = io.read_vector_csv(spark, path, ["relevance", "query_id", "doc_id"], n, {"relevance": "int"})
    return finish(back.select("relevance", "query_id", "doc_id",
                              *[F.get("features", i).alias(f"f{i}") for i in range(n)]))


@register("stats_map_roundtrip", """
SELECT t.term, t.df, t.cf, c.dn, c.cn FROM term_stats_web t CROSS JOIN coll_stats_web c
""", ("term_stats_web", "coll_stats_web"))
def stats_map_roundtrip(spark, sf_dir):
    ts, coll = stats.collection_stats(stats.field_token_arrays(web_collection(spark, sf_dir).docs))
    path = scratch_path(spark, "collection-stats")
    io.write_stats(ts, coll, path)
    terms, sc = io.read_stats(spark, path)
    return finish(terms.select("term", "df", "cf", F.lit(sc["dn"]).alias("dn"), F.lit(sc["cn"]).alias("cn")))


def _letor_df(spark, sf_dir):
    d = _divided(spark, sf_dir)
    line = io.letor_line(F.col("relevance"), hex_key("query_id"), F.array(*[F.col(c).cast("double") for c in SCOLS]),
                         F.col("doc_id"))
    return d.select("meta_step", "domain_id", "step", hex_key("query_id").alias("qid_key"),
                    "doc_id", line.alias("line"))


def _letor_sql(keys):
    """What lines of full doubles read back to; compared as values, since the
    engines print exponents differently."""
    return (f"SELECT {keys}relevance, CAST(CAST(('0x' || query_id) AS UBIGINT) AS VARCHAR) AS qid, "
            "'doc_id=' || doc_id AS comment, doc_id, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS v{k}" for k, c in enumerate(SCOLS)) + " FROM divided")


def _parsed(lines, keys=()):
    """Parsed lines beside the columns of their folders."""
    cols = [F.col(c).alias(c) for c in keys]
    p = lines.select(*cols, F.col("line").alias("value"))
    both = io.parse_letor(p, keep=keys)
    return both.select(*keys, "relevance", "qid", "comment", "doc_id",
                       *[F.get("features", k).alias(f"v{k}") for k in range(len(LTR))])


LETOR_KEYS = ("meta_step", "domain_id", "step")
LETOR_SQL = _letor_sql("meta_step, domain_id, step, ")


@register("letor_write", LETOR_SQL, ("divided",))
def letor_write(spark, sf_dir):
    path = scratch_path(spark, "letor")
    _letor_df(spark, sf_dir).select("meta_step", "domain_id", "step", "line").write.mode("overwrite") \
        .partitionBy("meta_step", "domain_id", "step").text(path)
    back = spark.read.schema("value string, meta_step string, domain_id int, step string").text(path)
    return finish(_parsed(back.withColumnRenamed("value", "line"), LETOR_KEYS))


@register("letor_parse", _letor_sql(""), ("divided",))
def letor_parse(spark, sf_dir):
    path = scratch_path(spark, "letor-lines")
    _letor_df(spark, sf_dir).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return finish(_parsed(spark.read.text(path).withColumnRenamed("value", "line")))


@register("weights_roundtrip", """
SELECT model, domain_id, idx, w FROM fixed_weights
WHERE domain_id IS NULL OR domain_id IN (SELECT domain_id FROM divided)
""", ("fixed_weights", "divided"))
def weights_roundtrip(spark, sf_dir):
    """Model files for the domains that hold queries (and the global model):
    one weight line per (model, domain), written as text in folders per model
    and domain ('global' for the shared model), then gathered back (S16)."""
    path = scratch_path(spark, "weights")
    doms = _divided(spark, sf_dir).select("domain_id").distinct()
    w = fixed_weights(spark)
    w = w.where(F.col("domain_id").isNull()).unionByName(w.join(doms, "domain_id", "left_semi"))
    w = w.withColumn("domain", F.coalesce(F.col("domain_id").cast("string"), F.lit("global")))
    lines = io.weights_to_lines(w, ["model", "domain"])
    lines.select("model", "domain", "line").write.mode("overwrite").partitionBy("model", "domain").text(path)
    back = spark.read.schema("line string, model string, domain string").text(path)
    back = back.select(F.col("value").alias("line") if "value" in back.columns else F.col("line"),
                       "model", "domain")
    g = io.lines_to_weights(back, ["model", "domain"])
    return finish(g.select("model", F.when(F.col("domain") == "global", F.lit(None))
                           .otherwise(F.col("domain")).cast("int").alias("domain_id"), "idx", "w"))


@register("materialize_stage", "SELECT query_id, doc_id, relevance FROM judgements_webf", ("judgements_webf",))
def materialize_stage(spark, sf_dir):
    path = scratch_path(spark, "judgements-stage")
    judg = _stage(spark, sf_dir)["judgements"]
    io.materialize(judg, path)              # computes and writes
    return finish(io.materialize(judg, path))  # finished copy found: read back only


@register("partitioned_ltr_sink", LETOR_SQL, ("divided",))
def partitioned_ltr_sink(spark, sf_dir):
    path = scratch_path(spark, "ltr-datasets")
    io.write_partitioned(_letor_df(spark, sf_dir), path, ["meta_step", "domain_id", "step"], ["qid_key", "doc_id"])
    back = io.read_partitioned(spark, path, "qid_key decimal(20,0), doc_id string, line string, "
                                            "meta_step string, domain_id int, step string")
    return finish(_parsed(back, LETOR_KEYS))


@register("partition_pruned_scan", """
SELECT domain_id, step, count(*) AS n_rows FROM divided WHERE meta_step = 'train' GROUP BY domain_id, step
""", ("divided",))
def partition_pruned_scan(spark, sf_dir):
    path = scratch_path(spark, "ltr-pruned")
    io.write_partitioned(_letor_df(spark, sf_dir), path, ["meta_step", "domain_id", "step"], ["qid_key", "doc_id"])
    back = io.read_partitioned(spark, path, "qid_key decimal(20,0), doc_id string, line string, "
                                            "meta_step string, domain_id int, step string")
    pruned = back.where(F.col("meta_step") == "train")  # PartitionFilters: only train folders are listed
    return finish(pruned.groupBy("domain_id", "step").agg(F.count("*").alias("n_rows")))
