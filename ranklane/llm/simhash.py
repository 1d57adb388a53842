"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit set where over half of its shingle hashes
have it. Two fingerprints link at ``max_bits`` or fewer differing bits, and a
document's component is the smallest id reachable by links.

Pairs are compared inside buckets of fingerprints that agree on all but
``max_bits`` of some bit blocks (two linked fingerprints always share such a
bucket). In a bucket, the distances of every fingerprint to fixed reference
fingerprints (pivots) are put in a table first. By the triangle inequality a
linked pair differs by at most ``max_bits`` in every coordinate: pairs beyond
that in the first coordinate are never formed (rows are sorted by it), pairs
beyond it in any other are discarded by the largest coordinate difference, and
only survivors have their bits compared. A bucket gives a spanning set of
links, not all its pairs.

A bucket of more than ``max_bucket`` fingerprints is not compared in one task:
its members go an equally exact way, by neighbours. Two fingerprints within
``max_bits`` have a word within half of it from both, so each member is sent to
all words that near, and members that meet there are linked.

Defined cases: a null text counts as empty; a text without words has
fingerprint 0, linked like any other; a null id takes part with its text and
never names a component, unless no id is known in it (component null);
repeated rows fall in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import id_and_text, null_ids, written
from ranklane.llm.graph import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
MAX_BUCKET = 16_384
#: expected fingerprints per bucket above which one more bit block is used
DENSE = 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    # bytes.lower() folds A-Z alone; bytes.split() cuts at 0x20 and 0x09-0x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[shingle:]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 18):
        hashes = np.array([digest(line[s:e - 1], seed) for s, e in
                           zip(starts[at:at + (1 << 18)], ends[at:at + (1 << 18)])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in rows["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": fp.view(np.int64)})

    return null_ids(id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, fp long"))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(count)], np.uint64)


class _Forest:
    """Smallest member of each linked set, over rows 0..n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fps, smaller member) of the pairs within ``max_bits``
    among rows with equal keys; ``keys`` are sorted."""
    table = np.bitwise_count(fps[:, None] ^ pivots(count)[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    first, forest = table[:, 0], _Forest(len(fps))
    rows, held, a_held, b_held = np.arange(len(fps)), 0, [], []
    for lag in range(1, len(fps)):
        rows = rows[rows + lag < len(fps)]
        rows = rows[(keys[rows] == keys[rows + lag]) & (first[rows + lag] - first[rows] <= max_bits)]
        if not len(rows):
            break
        near = rows[np.abs(table[rows] - table[rows + lag]).max(axis=1) <= max_bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + lag]) <= max_bits]
        if len(near):
            a_held.append(near)
            b_held.append(near + lag)
            held += len(near)
        if held > 1 << 20:
            forest.link(np.concatenate(a_held), np.concatenate(b_held))
            held, a_held, b_held = 0, [], []
    if held:
        forest.link(np.concatenate(a_held), np.concatenate(b_held))
    linked = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[linked], fps[forest.root[linked]]


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` of ``blocks`` bit blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]


def _blocks_for(n: int, max_bits: int) -> int:
    blocks = max_bits + 2
    while blocks < 16 and n / 2 ** (64 * (blocks - max_bits) // blocks) > DENSE:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, n: int, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links that span the components of the distinct ``fp`` values,
    of which there are about ``n``."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = block_masks(_blocks_for(n, max_bits), max_bits)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for i, m in enumerate(masks)])).alias("k")).select("k.part", "k.bits", "fp")

    def changes(rows: pd.DataFrame) -> np.ndarray:
        part, bits = rows["part"].to_numpy(), rows["bits"].to_numpy()
        return (part[1:] != part[:-1]) | (bits[1:] != bits[:-1])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        change = changes(rows)
        keys = np.concatenate([[0], np.cumsum(change)])
        alone = np.concatenate([[True], change]) & np.concatenate([change, [True]])
        fp = rows["fp"].to_numpy()[~alone].view(np.uint64)
        a, b = bucket_links(keys[~alone], fp, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "crowded": False})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Compares whole buckets; the last one of a batch waits for its rest."""
        held, crowded = None, None
        for rows in batches:
            if crowded is not None:  # the rest of a bucket found too large
                same = ((rows["part"] == crowded[0]) & (rows["bits"] == crowded[1])).to_numpy()
                yield pd.DataFrame({"a": rows["fp"][same], "b": rows["fp"][same], "crowded": True})
                rows = rows[~same]
                if not len(rows):
                    continue
                crowded = None
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            ends = np.flatnonzero(changes(rows))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut:
                yield compare(rows.iloc[:cut])
            held = rows.iloc[cut:]
            if len(held) > max_bucket:
                yield pd.DataFrame({"a": held["fp"], "b": held["fp"], "crowded": True})
                crowded, held = (held["part"].iloc[0], held["bits"].iloc[0]), None
        if held is not None and len(held):
            yield compare(held)

    found = written(keyed.repartition("part", "bits").sortWithinPartitions("part", "bits")
                    .mapInPandas(run, "a long, b long, crowded boolean"), "simhash-links")
    links = found.where("not crowded").select("a", "b")
    crowd = found.where("crowded").select(F.col("a").alias("fp")).distinct()
    return links.union(neighbour_links(crowd, max_bits))


def neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links by words within half of ``max_bits`` from both ends: at most
    C(64,0)+...+C(64,h) members meet at a word, and every two that meet are
    within ``2 h``, which is checked against ``max_bits`` when that is odd."""
    half = (max_bits + 1) // 2
    flips = np.array([sum(1 << i for i in chosen) for k in range(half + 1)
                      for chosen in combinations(range(64), k)], np.uint64)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for fp in rows["fp"].to_numpy():
                words = (np.uint64(int(fp) & (1 << 64) - 1) ^ flips).view(np.int64)
                yield pd.DataFrame({"word": words, "fp": np.full(len(words), fp)})

    met = (fps.mapInPandas(spread, "word long, fp long").groupBy("word")
           .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))
    if max_bits % 2 == 0:
        return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    pairs = met.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b"))
    return pairs.where((F.col("a") < F.col("b"))
                       & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "simhash-marked")
    groups = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-groups")
    links = fingerprint_links(groups.select("fp"), groups.count(), max_bits, max_bucket)
    parts = connected_components(links, "a", "b")
    member = parts.join(groups, F.col("node") == F.col("fp"))
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = member.join(lowest, "component").select("fp", "component_id")
    alike = (groups.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("low").alias("component_id")))
    shared = linked.union(alike).withColumn("known", F.lit(True))
    return (marked.join(shared, "fp", "left")
            .select("doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
                    .alias("component_id")))
