"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: stands for a null id on its way through pandas, which has no null integers
NO_ID = -(1 << 63)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns of the input
    can have any name; null ids are ``NO_ID``."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))


def null_ids(df: DataFrame) -> DataFrame:
    """``NO_ID`` back to null."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def held_out(id_col: Column) -> Column:
    """True for documents never learned from: crc32(id as text) mod 3 = 1.
    A null id counts as held out."""
    known = id_col.isNotNull() & (id_col != NO_ID)
    return F.when(known, F.crc32(id_col.cast("string").cast("binary")) % 3 == 1).otherwise(F.lit(True))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped`` (one id column). A row
    with a null id can be named by no decision and stays."""
    ids = dropped.select(F.col(dropped.columns[0]).alias(id_col)).distinct()
    return docs.join(ids, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])




#: bytes that a reading task goes through, about, once the cluster is full
READ_TASK = 256 << 20


def reading_tasks(spark: SparkSession, pieces: int, n_bytes: int) -> int:
    """Tasks to deal ``pieces`` of files to. Rows that name pieces are tiny, so
    a shuffle without a count would be merged into very few tasks."""
    least = max(3 * spark.sparkContext.defaultParallelism, -(-n_bytes // READ_TASK))
    return max(1, min(pieces, least))
