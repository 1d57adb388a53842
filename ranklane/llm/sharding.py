"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of part sizes. The two of largest spread are
combined oppositely ordered, the largest part of one with the smallest of the
other, until one is left. Groups
(documents of equal text) are first differenced in blocks chosen by hash, each
into ``BUNDLES`` bundles; the bundles are differenced like groups in turn, until
one block holds them all and is differenced into the shards. A large group is a
bundle of its own, so it is weighed against all others at the end. No task
holds more than a block of sizes, and the driver none.

Defined cases: a null text counts as empty, and is in its group; a null id has
a row like any other; repeated rows each have a slot; fewer groups than shards
leave shards empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import id_and_text, null_ids, written

SHARDS = 40
OVERHEAD = 16
#: groups (or bundles) differenced in one task, and the bundles it makes of them
BLOCK = 10_000
BUNDLES = 400
#: rows of a (shard, chunk) numbered together, about
CHUNK_ROWS = 50_000


def difference(tuples: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over rows of part sizes: the final part (0 to m-1) of
    each part of each row."""
    n, m = tuples.shape
    sizes = {i: tuples[i] for i in range(n)}
    heap = [(-int(t.max() - t.min()), i) for i, t in sizes.items()]
    heapq.heapify(heap)
    steps = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sizes.pop(a), sizes.pop(b)
        down, up = np.argsort(-x, kind="stable").astype(np.int16), np.argsort(y, kind="stable").astype(np.int16)
        made, c = x[down] + y[up], n + len(steps)
        steps.append((a, down, b, up))
        sizes[c] = made
        heapq.heappush(heap, (-int(made.max() - made.min()), c))
    part = np.empty((n + len(steps), m), np.int16)
    part[-1] = np.arange(m)
    for c in range(len(steps) - 1, -1, -1):
        a, down, b, up = steps[c]
        part[a][down] = part[n + c]
        part[b][up] = part[n + c]
    return part[:n]


def partition_groups(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK, bundles: int = BUNDLES) -> DataFrame:
    """(item, shard) for distinct (item, bytes)."""

    def level(parts: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["bytes", "item"], ascending=[False, True])
            tuples = np.zeros((len(rows), parts), np.int64)
            tuples[:, 0] = rows["bytes"]
            return pd.DataFrame({"item": rows["item"], "bytes": rows["bytes"],
                                 "up": rows["node"].to_numpy() * parts + difference(tuples)[:, 0]})
        return run

    items, placed = groups, None
    while True:
        blocks = max(1, -(-items.count() // block))
        parts = shards if blocks == 1 else min(bundles, block // 4)  # each level has fewer items
        moved = written(items.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(blocks))).groupBy("node")
                        .applyInPandas(level(parts), "item long, bytes long, up long"), "shard-level")
        step = moved.select(F.col("item").alias("now"), "up")
        placed = (moved.select("item", F.col("up").alias("now")) if placed is None else
                  placed.join(step, "now").select("item", F.col("up").alias("now")))
        if blocks == 1:
            return placed.select("item", F.col("now").cast("int").alias("shard"))
        items = moved.groupBy(F.col("up").alias("item")).agg(F.sum("bytes").alias("bytes"))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) for every row: shards of
    near equal bytes, groups of equal text whole, slots gapless from 0."""
    text = F.coalesce("text", F.lit(""))
    marked = written(null_ids(id_and_text(docs, id_col, text_col)).select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest")), "shard-marked")
    # two groups whose digests share this hash would only be kept together
    marked = marked.withColumn("item", F.xxhash64("digest"))
    where = partition_groups(marked.groupBy("item").agg(F.sum("size").alias("bytes")), shards, block)
    # a group of very many copies is spread over the numbered chunks, in one shard
    chunks = max(1, marked.count() // (shards * CHUNK_ROWS))
    placed = written(marked.join(where, "item").withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks))), "shard-placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id"))
    return (placed.withColumn("number", number).join(starts, ["shard", "chunk"])
            .select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("number") - 1).alias("slot")))
