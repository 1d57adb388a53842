"""Distributed global ordering (O1, W3 support).

A global ``row_number()`` without PARTITION BY runs in one task. Instead the
rows are range-partitioned on the sort key (sampled boundaries), sorted inside
each partition, numbered locally with ``monotonically_increasing_id`` (which
encodes partition id and position), and shifted by the number of rows in all
earlier partitions. Only the per-partition counts (one row per partition)
are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.session import checkpoint_dir

_LOW = (1 << 33) - 1


def global_position(df: DataFrame, order: list, n_parts: int | None = None,
                    out: str = "pos") -> DataFrame:
    """Adds ``out`` = 1-based position of each row in the total order
    ``order`` (the order must be total, e.g. end with a unique key).

    The range-partitioned, sorted rows are checkpointed to the shared
    checkpoint folder so the positions are computed once and survive lost
    executors."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    part = F.shiftright(F.col("__mid"), 33)
    local = F.col("__mid").bitwiseAND(F.lit(_LOW))
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__c")).collect()
    offsets, acc = {}, 0
    for r in sorted(counts, key=lambda r: r["__p"]):
        offsets[r["__p"]] = acc
        acc += r["__c"]
    off = F.lit(0)
    if offsets:
        off = F.element_at(F.create_map(*[x for p, o in offsets.items()
                                         for x in (F.lit(p), F.lit(o))]), part)
    return ranged.withColumn(out, off + local + 1).drop("__mid")
