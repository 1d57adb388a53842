"""File sources and sinks.

Every writer targets a folder (Spark's part files), every reader takes an
explicit schema. Paths for intermediate results live under the shared
checkpoint folder (``ranklane.session.scratch_path``), never a machine-local
temporary folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---- materialised stages (S20) --------------------------------------------------

def has_success(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def input_state(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of every file below ``paths``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stage_path(spark: SparkSession, base: str, name: str, version: int, paths: list[str], **params) -> str:
    """Where a stage's result belongs: a folder named by the input files with
    their sizes and times, the parameters and the version of its code, so a
    changed input, parameter or version never finds an old result (S20)."""
    import hashlib
    import json
    state = json.dumps([version, input_state(spark, paths), params], sort_keys=True, default=str)
    return f"{base}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:20]}"


def materialize(df: DataFrame, path: str, override: bool = False) -> DataFrame:
    """Write ``df`` as Parquet unless a finished copy (``_SUCCESS``) exists,
    then read it back: a stage computed once, surviving lost executors.
    ``override=True`` recomputes and replaces it."""
    spark = df.sparkSession
    if override or not has_success(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet dealt to buckets by ``keys`` and read it back as
    a table that Spark knows to be so dealt: joins and groups on the keys run
    without an exchange. ``buckets`` defaults to the shuffle partitions. Rows
    are dealt before they are written, so a bucket is one file."""
    import uuid
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path)
     .format("parquet").saveAsTable(name))
    return spark.table(name)


# ---- JSON lines (S4, S5) ---------------------------------------------------------

def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---- id lists (S6) -----------------------------------------------------------------

def write_id_list(ids: DataFrame, path: str, col: str) -> None:
    ids.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def load_id_set(spark: SparkSession, path: str, col: str = "id") -> DataFrame:
    """Lines stripped of surrounding whitespace, empty lines dropped, deduplicated."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias(col))
    return t.where(F.col(col) != "").distinct()


# ---- keyed store (S7) --------------------------------------------------------------

def save_store(df: DataFrame, path: str, key: str, order: Column | None = None) -> DataFrame:
    """Keyed table, one row per key; with ``order`` the last row per key wins
    (as repeated dict assignment), otherwise the smallest row per key."""
    from pyspark.sql import Window
    if order is not None:
        w = Window.partitionBy(key).orderBy(order.desc())
        df = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    else:
        rest = [c for c in df.columns if c != key]
        if rest:
            df = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__s")).select(
                *[F.col(f"__s.{c}").alias(c) if c != key else F.col(key) for c in df.columns])
        else:
            df = df.distinct()
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- delimited text (S8, S9, S10) -----------------------------------------------------

_TSV = {"sep": "\t", "header": "true", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false", "escape": "\"", "multiLine": "false"}


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_TSV).csv(path)


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header TSV with an explicit schema; whitespace is kept as written and
    an empty field reads as an empty string (no text is taken for NULL)."""
    return spark.read.schema(schema).options(**_TSV).option("nullValue", "\u0000").csv(path)


def write_vector_csv(df: DataFrame, path: str, id_cols: list[str], vec: str = "features", n: int | None = None) -> None:
    """Headerless CSV: id columns, then the vector spread over columns."""
    if n is None:
        n = df.select(F.max(F.size(vec))).first()[0] or 0
    cols = [F.col(c).cast("string") for c in id_cols] + [F.get(vec, i).alias(f"v{i}") for i in range(n)]
    df.select(*cols).write.mode("overwrite").option("header", "false").csv(path)


def read_vector_csv(spark: SparkSession, path: str, id_cols: list[str], n: int,
                    id_types: dict[str, str] | None = None, vec: str = "features") -> DataFrame:
    """Positional CSV → ids + ``ARRAY<DOUBLE>``."""
    id_types = id_types or {}
    fields = [T.StructField(c, T.StringType()) for c in id_cols] + [
        T.StructField(f"v{i}", T.DoubleType()) for i in range(n)]
    raw = spark.read.schema(T.StructType(fields)).option("header", "false").csv(path)
    return raw.select(*[F.col(c).cast(id_types.get(c, "string")).alias(c) for c in id_cols],
                      F.array(*[F.col(f"v{i}") for i in range(n)]).alias(vec))


# ---- collection statistics as keyed JSON (S11) ------------------------------------

def write_stats(term_stats: DataFrame, coll: dict, path: str) -> None:
    """Keyed export of the df/cf dictionaries: one JSON line per term (never
    one row holding the whole vocabulary) plus a one-line scalar file."""
    term_stats.select("term", "df", "cf").write.mode("overwrite").json(f"{path}/terms")
    spark = term_stats.sparkSession
    spark.createDataFrame([(int(coll["dn"]), int(coll["cn"]))], "dn long, cn long") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/scalars")


def read_stats(spark: SparkSession, path: str):
    terms = spark.read.schema("term string, df long, cf long").json(f"{path}/terms")
    sc = spark.read.schema("dn long, cn long").json(f"{path}/scalars").first()
    return terms, {"dn": sc["dn"], "cn": sc["cn"]}


# ---- LETOR (S12, S13) ------------------------------------------------------------------

def letor_line(relevance: Column, qid: Column, features: Column, doc_id: Column, fmt: str | None = None) -> Column:
    """``rel qid:Q 1:v 2:v … # doc_id=D`` (1-based feature numbers). Values are
    the shortest decimals that read back to the same double, or by ``fmt``."""
    idx = F.transform(features, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"),
                                                       F.format_string(fmt, v) if fmt else v.cast("string")))
    return F.concat_ws(" ", relevance.cast("string"), F.concat(F.lit("qid:"), qid.cast("string")),
                       F.array_join(idx, " "), F.lit("#"), F.concat(F.lit("doc_id="), doc_id))


def parse_letor(lines: DataFrame, col: str = "value", keep=()) -> DataFrame:
    """(…keep, relevance, qid, features ARRAY<DOUBLE>, comment, doc_id) from
    LETOR lines; a missing comment gives ``""`` and doc id ``_``."""
    line = F.trim(F.col(col))
    head = F.split(line, "#", 2)
    body = F.trim(F.get(head, 0))
    comment = F.coalesce(F.trim(F.get(head, 1)), F.lit(""))
    parts = F.split(body, r"\s+")
    pairs = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    feats = F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)).cast("double"))
    doc = F.when(comment.contains("="), F.trim(F.split_part(comment, F.lit("="), F.lit(2)))).otherwise(F.lit("_"))
    return lines.select(
        *keep, F.get(parts, 0).cast("int").alias("relevance"),
        F.split_part(F.get(parts, 1), F.lit(":"), F.lit(2)).alias("qid"),
        feats.alias("features"), comment.alias("comment"), doc.alias("doc_id"))


# ---- partitioned dataset tree (S14, S15) ------------------------------------------------

def write_partitioned(df: DataFrame, path: str, keys: list[str], sort: list[str] | None = None) -> None:
    """One folder per key combination, files sorted by ``sort`` inside (O2).
    Rows are range-partitioned on (keys, sort): a folder holding a third of
    all rows is written by many tasks (several ordered files), never one."""
    order = [*keys, *(sort or [])]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema) -> DataFrame:
    """Partition discovery on the folder names; filters on partition columns
    prune folders. A missing step folder is simply an empty group."""
    return spark.read.schema(schema).parquet(path)


# ---- model weight files (S16) ----------------------------------------------------------

def weights_to_lines(weights: DataFrame, keys: list[str]) -> DataFrame:
    """One ``1:w 2:w …`` line per model key (1-based feature numbers, the
    shortest decimal that reads back to the same double)."""
    g = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("ws"))
    line = F.array_join(F.transform("ws", lambda e: F.concat((e["idx"] + 1).cast("string"), F.lit(":"),
                                                           e["w"].cast("string"))), " ")
    return g.select(*keys, line.alias("line"))


def lines_to_weights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Gather model lines back into (…keys, idx, w)."""
    pairs = F.split(F.trim(F.col("line")), r"\s+")
    return lines.select(*keys, F.posexplode(pairs).alias("__p", "__kv")).select(
        *keys, (F.split_part(F.col("__kv"), F.lit(":"), F.lit(1)).cast("int") - 1).alias("idx"),
        F.split_part(F.col("__kv"), F.lit(":"), F.lit(2)).cast("double").alias("w"))
