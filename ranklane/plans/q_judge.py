"""Text/URL functions and the judgement stage (Entry A) as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions import text as tx
from ranklane.functions.constants import DEFAULT_PUBLIC_SUFFIXES, TEXT_LENGTH_LIMIT
from ranklane.operators import lang, ordering, qrels as qr, stats
from ranklane.plans.registry import finish, register
from ranklane.plans.stages import declared_languages, judgements_stage
from ranklane.sources.tables import conv_collection, lang_training_docs, web_collection


def _docs(spark, sf_dir):
    return web_collection(spark, sf_dir).docs


# ---- text and URL -----------------------------------------------------------

@register("shorten_text", f"""
SELECT doc_id, length(text) AS n_chars, length(substring(text, 1, {TEXT_LENGTH_LIMIT})) AS n_short,
       md5(substring(text, 1, {TEXT_LENGTH_LIMIT})) AS short_md5
FROM docs_web
""", ("docs_web",))
def shorten_text(spark, sf_dir):
    s = tx.shorten_text("text", TEXT_LENGTH_LIMIT)
    return finish(_docs(spark, sf_dir).select(
        "doc_id", F.length("text").alias("n_chars"), F.length(s).alias("n_short"),
        F.md5(s).alias("short_md5")))


@register("sentence_count", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+(\s|$)'),
                               lambda x: length(trim(x)) > 0)) AS sentence_count
FROM docs_web
""", ("docs_web",))
def sentence_count(spark, sf_dir):
    return finish(_docs(spark, sf_dir).select(
        "doc_id", tx.sentence_count("text").alias("sentence_count")))


@register("url_host", """
SELECT doc_id, url, string_split(url, '/')[3] AS host,
       length(url) - length(replace(url, '/', '')) - 2 AS url_depth
FROM docs_web
UNION ALL
SELECT doc_id, url, string_split(url, '/')[3] AS host,
       length(url) - length(replace(url, '/', '')) - 2 AS url_depth
FROM docs_conv
""", ("docs_web", "docs_conv"))
def url_host(spark, sf_dir):
    d = _docs(spark, sf_dir).unionByName(conv_collection(spark, sf_dir).docs)
    return finish(d.select("doc_id", "url", tx.url_host("url").alias("host"),
                           tx.url_depth("url").alias("url_depth")))


PSL_SQL = "[" + ", ".join(f"'{s}'" for s in DEFAULT_PUBLIC_SUFFIXES) + "]"
SLD_SQL = f"""
SELECT doc_id, host,
       CASE WHEN host IS NULL THEN NULL
            ELSE array_to_string(list_slice(labels, n - least(ps + 1, n) + 1, n), '.') END AS sld
FROM (SELECT doc_id, host, labels, n,
             greatest(coalesce(list_max(list_transform(range(1, n + 1), lambda d:
                 CASE WHEN list_contains({PSL_SQL}, array_to_string(list_slice(labels, n - d + 1, n), '.'))
                      THEN d ELSE 0 END)), 0), 1) AS ps
      FROM (SELECT doc_id, host, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n
            FROM (SELECT doc_id, string_split(url, '/')[3] AS host FROM docs_web
                  UNION ALL SELECT doc_id, string_split(url, '/')[3] AS host FROM docs_conv)))
"""


def _sld(spark, sf_dir):
    d = _docs(spark, sf_dir).unionByName(conv_collection(spark, sf_dir).docs)
    h = d.select("doc_id", tx.url_host("url").alias("host"))
    return h.select("doc_id", "host", tx.registrable_domain("host", DEFAULT_PUBLIC_SUFFIXES).alias("sld"))


@register("registrable_domain", SLD_SQL, ("docs_web", "docs_conv"))
def registrable_domain(spark, sf_dir):
    return finish(_sld(spark, sf_dir))


@register("sld_counts", f"SELECT sld, count(*) AS n FROM ({SLD_SQL}) GROUP BY sld",
          ("docs_web", "docs_conv"))
def sld_counts(spark, sf_dir):
    return finish(stats.sld_counts(_sld(spark, sf_dir)))


@register("hex_id_key", """
SELECT doc_id, CAST(CAST(('0x' || doc_id) AS UBIGINT) AS VARCHAR) AS id_key FROM docs_web
UNION ALL
SELECT doc_id, CAST(CAST(('0x' || doc_id) AS UBIGINT) AS VARCHAR) AS id_key FROM docs_conv
""", ("docs_web", "docs_conv"))
def hex_id_key(spark, sf_dir):
    d = _docs(spark, sf_dir).unionByName(conv_collection(spark, sf_dir).docs)
    return finish(d.select("doc_id", tx.hex_key("doc_id").cast("string").alias("id_key")))


@register("sort_by_hex_id", """
SELECT doc_id, row_number() OVER (ORDER BY CAST(('0x' || doc_id) AS UBIGINT), doc_id) AS pos
FROM (SELECT doc_id FROM docs_web UNION SELECT doc_id FROM docs_conv)
""", ("docs_web", "docs_conv"))
def sort_by_hex_id(spark, sf_dir):
    ids = (_docs(spark, sf_dir).select("doc_id")
           .unionByName(conv_collection(spark, sf_dir).docs.select("doc_id")).distinct())
    return finish(ordering.global_position(ids, [tx.hex_key("doc_id"), F.col("doc_id")])
                  .select("doc_id", "pos"))


# ---- language identification ------------------------------------------------

@register("detect_languages", "SELECT doc_id, title_language, text_language FROM doc_lang_web",
          ("doc_lang_web",))
def detect_languages(spark, sf_dir):
    profile = lang.train_profile(lang_training_docs(spark, sf_dir)).cache()
    return finish(lang.detect_doc_languages(_docs(spark, sf_dir), profile))


def _profile(spark, sf_dir):
    return lang.train_profile(lang_training_docs(spark, sf_dir)).cache()


@register("detect_query_languages", "SELECT query_id, text_language FROM query_lang_web", ("query_lang_web",))
def detect_query_languages(spark, sf_dir):
    return finish(lang.detect_query_languages(web_collection(spark, sf_dir).queries, _profile(spark, sf_dir)))


@register("filter_detected_docs", "SELECT doc_id FROM kept_docs_det", ("kept_docs_det",))
def filter_detected_docs(spark, sf_dir):
    """The filter fed by the detector, not by declared languages."""
    found = lang.detect_doc_languages(_docs(spark, sf_dir), _profile(spark, sf_dir))
    return finish(qr.filter_docs_by_lang(found, ["en"]))


@register("filter_detected_queries", "SELECT query_id FROM kept_queries_det", ("kept_queries_det",))
def filter_detected_queries(spark, sf_dir):
    found = lang.detect_query_languages(web_collection(spark, sf_dir).queries, _profile(spark, sf_dir))
    return finish(qr.filter_queries_by_lang(found, ["en"]))


# ---- judgements (declared page languages feed the filters) ------------------

def _stage(spark, sf_dir, **options):
    c = web_collection(spark, sf_dir)
    doc_lang, query_lang = declared_languages(c.docs)
    return judgements_stage(c, doc_lang, query_lang, **options)


#: raise with any change of what the stage computes
JUDGEMENTS_VERSION = 2


def judgement_table(spark, sf_dir, **options):
    """The judgements, materialised once per state of the input, parameters
    and version in the shared checkpoint folder; later stages read the
    finished copy (stage skip, S20)."""
    from ranklane.session import checkpoint_dir
    from ranklane.sources.formats import has_success, materialize, stage_path
    path = stage_path(spark, checkpoint_dir(spark), "judgements", JUDGEMENTS_VERSION,
                      [f"{sf_dir.rstrip('/')}/pages.parquet"], **options)
    if has_success(spark, path):
        return spark.read.parquet(path)
    return materialize(_stage(spark, sf_dir, **options)["judgements"], path)


@register("filter_docs_by_lang", "SELECT doc_id FROM kept_docs_web", ("kept_docs_web",))
def filter_docs_by_lang(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["kept_docs"])


@register("filter_queries_by_lang", "SELECT query_id FROM kept_queries_web", ("kept_queries_web",))
def filter_queries_by_lang(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["kept_queries"])


@register("filter_qrels", "SELECT query_id, doc_id FROM qrels_webf", ("qrels_webf",))
def filter_qrels(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["qrels"])


@register("relevant_docs", """
SELECT DISTINCT query_id, doc_id
FROM (SELECT query_id, doc_id FROM qrels_web UNION ALL SELECT query_id, doc_id FROM qrels_conv)
""", ("qrels_web", "qrels_conv"))
def relevant_docs(spark, sf_dir):
    q = web_collection(spark, sf_dir).qrels.unionByName(conv_collection(spark, sf_dir).qrels)
    return finish(qr.relevant_docs(q))


@register("queries_with_positives", """
SELECT query_id FROM qrels_webf INTERSECT SELECT query_id FROM kept_queries_web
""", ("qrels_webf", "kept_queries_web"))
def queries_with_positives(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["queries_with_positives"])


@register("query_lookup", """
SELECT i.query_id, coalesce(q.text, '') AS text
FROM (SELECT query_id FROM qrels_webf INTERSECT SELECT query_id FROM kept_queries_web) i
LEFT JOIN queries_web q ON q.query_id = i.query_id
""", ("qrels_webf", "kept_queries_web", "queries_web"))
def query_lookup(spark, sf_dir):
    st = _stage(spark, sf_dir)
    return finish(qr.query_lookup(st["queries_with_positives"], web_collection(spark, sf_dir).queries))


@register("doc_lookup", """
SELECT d.doc_id, d.title, d.url FROM (SELECT DISTINCT doc_id FROM judgements_webf) j
JOIN docs_web d ON d.doc_id = j.doc_id
""", ("judgements_webf", "docs_web"))
def doc_lookup(spark, sf_dir):
    return finish(qr.doc_lookup(judgement_table(spark, sf_dir), web_collection(spark, sf_dir).docs)
                  .select("doc_id", "title", "url"))


@register("positive_count_hist", """
SELECT n_pos, count(*) AS n_queries
FROM (SELECT query_id, count(DISTINCT doc_id) AS n_pos FROM
      (SELECT query_id, doc_id FROM qrels_web UNION ALL SELECT query_id, doc_id FROM qrels_conv)
      GROUP BY query_id)
GROUP BY n_pos
""", ("qrels_web", "qrels_conv"))
def positive_count_hist(spark, sf_dir):
    q = web_collection(spark, sf_dir).qrels.unionByName(conv_collection(spark, sf_dir).qrels)
    return finish(qr.positive_count_hist(qr.relevant_doc_counts(q)))


@register("rank_sampled_queries", """
SELECT query_id, doc_id, round(score, 6) + 0.0 AS score, rank FROM sampled_webf
""", ("sampled_webf",))
def rank_sampled_queries(spark, sf_dir):
    """A limit that binds: 20 of the queries with hits, in seeded order."""
    return finish(_stage(spark, sf_dir, query_limit=20)["ranked"])


@register("negatives_topn", "SELECT query_id, doc_id, rank FROM negatives_webf", ("negatives_webf",))
def negatives_topn(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["negatives"].select("query_id", "doc_id", "rank"))


@register("attach_qrels", "SELECT query_id, doc_id, relevance FROM judgements_webf", ("judgements_webf",))
def attach_qrels(spark, sf_dir):
    return finish(_stage(spark, sf_dir)["judgements"])


@register("distinct_judged_ids", """
SELECT DISTINCT 'doc' AS kind, doc_id AS id FROM judgements_webf
UNION ALL
SELECT DISTINCT 'query' AS kind, query_id AS id FROM judgements_webf
""", ("judgements_webf",))
def distinct_judged_ids(spark, sf_dir):
    d, q = qr.distinct_judged_ids(judgement_table(spark, sf_dir))
    return finish(d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")).unionByName(
        q.select(F.lit("query").alias("kind"), F.col("query_id").alias("id"))))
