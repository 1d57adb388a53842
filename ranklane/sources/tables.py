"""Scans of the driver tables and the derived ranking collections.

The ranking collections are defined identically in the DuckDB oracle
(``ranklane.plans.oracle_views``): web pages become documents, known-item queries
and their single positive; conversations give a second collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.functions.text import first_tokens, hex_id

SCHEMAS: dict[str, T.StructType] = {
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]),
}

DOCS_SCHEMA = "doc_id string, title string, text string, url string, lang string"
QUERIES_SCHEMA = "query_id string, text string"
QRELS_SCHEMA = "query_id string, doc_id string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with an explicit schema (no inference)."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- web collection -------------------------------------------------------

TITLE_RE = r"(?s)<title>(.*?)</title>"
ARTICLE_RE = r"(?s)<article>(.*?)</article>"
LANG_RE = r"<html lang=\"([^\"]*)\""
TAG_RE = r"<[^>]*>"


def web_docs(pages: DataFrame) -> DataFrame:
    """docs(doc_id, title, text, url, lang) from raw pages (S1); the text is
    that of all articles of a page."""
    article = F.array_join(F.regexp_extract_all("html", F.lit(ARTICLE_RE), 1), " ")
    return pages.select(
        hex_id("page_id").alias("doc_id"),
        F.regexp_extract("html", TITLE_RE, 1).alias("title"),
        F.trim(F.regexp_replace(article, TAG_RE, " ")).alias("text"),
        F.col("url"),
        F.regexp_extract("html", LANG_RE, 1).alias("lang"),
    )


def web_queries(docs: DataFrame) -> DataFrame:
    """Known-item queries: article tokens 6..11 joined by a blank (S2). The
    rest of the article is not tokenised for them."""
    return docs.select(
        F.col("doc_id").alias("query_id"),
        F.array_join(F.slice(first_tokens("text", 11), 6, 6), " ").alias("text"),
    )


def web_qrels(docs: DataFrame) -> DataFrame:
    """Each known-item query's positive is its own page (S3)."""
    return docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id"))


# ---- conversation collection ---------------------------------------------

FIRST_SENTENCE_RE = r"^([^.!?\n]*[.!?]?)"


def conv_docs(conversations: DataFrame) -> DataFrame:
    """Assistant turns as documents; title = first sentence; no URL."""
    return conversations.where(F.col("role") == "assistant").select(
        hex_id(F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.trim(F.regexp_extract("text", FIRST_SENTENCE_RE, 1)).alias("title"),
        F.col("text"),
        F.lit(None).cast("string").alias("url"),
        F.lit("en").alias("lang"),
    )


def conv_queries(conversations: DataFrame) -> DataFrame:
    """User turns as queries."""
    return conversations.where(F.col("role") == "user").select(
        hex_id(F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text"),
    )


def conv_qrels(conversations: DataFrame) -> DataFrame:
    """The assistant turn directly after a user turn is its positive."""
    u = conversations.where(F.col("role") == "user").select("conv_id", "turn")
    a = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("a_turn"))
    return u.join(a, ["conv_id", "turn"]).select(
        hex_id(F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        hex_id(F.col("conv_id") * 1000 + F.col("a_turn")).alias("doc_id"),
    )


class Collection:
    """The three ranking tables of one collection, built lazily."""

    def __init__(self, docs: DataFrame, queries: DataFrame, qrels: DataFrame):
        self.docs = docs
        self.queries = queries
        self.qrels = qrels


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` only when the scan yields fewer partitions
    than the cluster runs tasks (a few large files / row groups): the per-row
    text work then uses every core. A large input already has more splits
    than cores and is left as scanned — no extra shuffle of the corpus."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par, key)
    return df


def _keep(df: DataFrame) -> DataFrame:
    """Parsed collections are read by many jobs (filters, index, features):
    persisted once; Spark's cache manager matches the same plan on later calls."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def web_collection(spark: SparkSession, sf_dir: str) -> Collection:
    docs = _keep(web_docs(spread(read_table(spark, sf_dir, "pages"), "page_id")))
    return Collection(docs, web_queries(docs), web_qrels(docs))


def conv_collection(spark: SparkSession, sf_dir: str) -> Collection:
    conv = spread(read_table(spark, sf_dir, "conversations"), "conv_id")
    return Collection(_keep(conv_docs(conv)), conv_queries(conv), conv_qrels(conv))


def lang_training_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text for the language profile: documents(doc_id, text, lang)."""
    return spread(read_table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("label"))
