"""The corpus pipeline: language, near copies, repeated strings, benchmark
passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and reads it back as the next
stage's documents. All but the last return the columns of ``documents``. Stages
decide about rows, named by a hash of id and text: rows that share an id are
judged by their own texts, and rows without an id like all others (only the
removal of repeated strings, which needs an order of ids, leaves those as they
are). Rows equal in id and text are one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.llm import bpe, decontaminate, langid, simhash, suffix_dedup
from ranklane.llm.common import read_table, written

#: a language is accepted from this posterior on
MIN_LANGUAGE_SCORE = 0.5


#: a column of a row's name, while a stage runs
ROW = "_pipeline_row"


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: without a letter (``und``) or with
    no language at half the probability they go."""
    return langid.keep_known(docs, langid.fit(docs), MIN_LANGUAGE_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints, that of the smallest
    id (without any: one of the group)."""
    rows = named(docs)
    found = simhash.near_duplicates(rows, id_col=ROW, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)
    group = found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("_group")).distinct()
    first = (rows.select(ROW, "doc_id").join(group, ROW).groupBy("_group")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(ROW).alias("c")))["c"].alias(ROW)))
    return rows.join(first, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents. Bytes of a
    character that was cut are dropped; a document left without text stays,
    with an empty text."""
    found = (suffix_dedup.remove_repeats(docs, as_text=True).where("n_removed > 0")
             .select("doc_id", F.col("digest").alias("_digest"), F.col("kept").alias("_text")).dropDuplicates(["doc_id", "_digest"]))
    joined = docs.withColumn("_digest", F.xxhash64("text")).join(found, ["doc_id", "_digest"], "left")
    text = F.coalesce("_text", "text")
    made = {"text": text, "n_chars": F.when(F.col("_text").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("n_chars"))}
    return joined.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows = named(docs)
    found = decontaminate.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col=ROW)
    return (rows.join(found.select(F.col("doc_id").alias(ROW)), ROW, "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of what is left."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs


#: fingerprints, language posteriors and merges are beyond SQL
ORACLE_SQL = None
