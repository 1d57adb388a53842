"""Document fingerprints: one-permutation MinHash, densified, packed, corrected.

A text's set is its shingles of ``SHINGLE`` words (fewer words: the whole
sequence, also the empty one); words are runs without ASCII white space, A-Z
small. Each shingle is hashed once. The hash's top bits name one of ``BINS``
bins, and a bin keeps its smallest hash. A bin that got none takes the value of
the first filled bin in its own pseudorandom order of all bins (optimal
densification: each empty bin draws its source by itself, so two bins seldom
share one by design). Of each bin's value ``BITS`` low bits are stored, after
mixing with the bin's number; copies of one value in many bins then agree by
chance independently of each other.

Two different values agree in ``BITS`` bits with probability ``2 ** -BITS``, so
the likeness of two fingerprints is the share of agreeing bins, corrected for
that: ``(share - c) / (1 - c)``, at least 0.

``edited_fingerprints`` also makes the fingerprint of each text after an edit:
its last quarter of characters replaced by as many of the next document's first
ones. Documents are dealt to buckets of consecutive ids. Each bucket also gets
the first document of the next one (the last bucket that of the first), so a
task meets a document and its successor side by side and holds two texts at a
time. Only the first bucket bounds, at most ``MAX_BUCKETS`` ids, are broadcast.

Defined cases: a null text counts as empty; rows with a null id come before all
others; rows that share an id are ordered by a hash of their texts; one
document alone is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import NO_ID, id_and_text, null_ids

SHINGLE = 5
BINS = 512
BITS = 4
#: bytes of text a bucket of consecutive documents, about, and the most buckets
BUCKET = 2 << 20
MAX_BUCKETS = 1 << 16
_PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bin_order(bins: int) -> np.ndarray:
    """[i, j]: the place of bin j in the order in which bin i looks for a value."""
    drawn = _mixed(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(_ODD)).reshape(bins, bins)
    return drawn.argsort(axis=1).argsort(axis=1).astype(np.int32)


_ORDER = _bin_order(BINS)
_BIN_SALT = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(_ODD)


def word_hashes(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass").lower()
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each shingle of a sequence of words; one for a short one."""
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, min(len(words), SHINGLE), np.uint64)
    for j in range(min(SHINGLE, len(words))):
        total = total * np.uint64(_ODD) + words[j:j + n]
    return _mixed(total)


def bin_values(shingles: np.ndarray) -> np.ndarray:
    """The low bits of each bin's value, of a set that is not empty."""
    lowest = np.sort(shingles)
    bins = (lowest >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = bins[first]
    value = np.empty(BINS, np.uint64)
    value[filled] = lowest[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        value[empty] = value[filled[_ORDER[empty][:, filled].argmin(axis=1)]]
    return (_mixed(value + _BIN_SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray) -> bytes:
    bits = np.unpackbits(values[:, None], axis=1)[:, 8 - BITS:]
    return np.packbits(bits.ravel()).tobytes()


def unpacked(fingerprint: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(fingerprint, np.uint8)).reshape(-1, BITS)
    return np.packbits(np.pad(bits, ((0, 0), (8 - BITS, 0))), axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the shared part of two sets, from their bins' bits."""
    chance = 2.0 ** -BITS
    return max(0.0, (np.count_nonzero(a == b) / len(a) - chance) / (1 - chance))


def fingerprint(text: str | None) -> bytes:
    return packed(bin_values(shingle_hashes(word_hashes(text or ""))))


class _Document:
    def __init__(self, doc_id: int, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.words = word_hashes(self.text)
        self.shingles = shingle_hashes(self.words)
        self.bins = bin_values(self.shingles)

    def edited(self, after: str) -> tuple[str, np.ndarray]:
        """The edited text and its bins; what stays of the text is not hashed again."""
        moved = len(self.text) // 4
        stay = self.text[:len(self.text) - moved]
        text = stay + after[:moved]
        cut = stay.rfind(" ")
        if cut < 0:
            return text, bin_values(shingle_hashes(word_hashes(text)))
        whole = len(stay[:cut].encode("utf-8", "surrogatepass").split())
        words = np.concatenate([self.words[:whole], word_hashes(text[cut:])])
        known = max(0, whole - SHINGLE + 1)
        new = shingle_hashes(words[known:]) if not known or len(words) > whole else np.zeros(0, np.uint64)
        return text, bin_values(np.concatenate([self.shingles[:known], new]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint is ``BINS * BITS`` bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fingerprint": [fingerprint(t) for t in rows["text"]]})

    return null_ids(id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, fingerprint binary"))


def _with_successors(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (doc_id, text) in buckets of consecutive ids, sorted, each
    followed by the first document of the next bucket (``guest``)."""
    total, least = rows.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    n = int(min(MAX_BUCKETS, max(1, -(-(total or 0) // size))))
    starts = [] if least is None else [least]
    if least is not None and n > 1:
        # values of the column itself, so every bound is a document's id
        starts += rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bounds = np.unique(np.array(starts, np.int64))

    @F.pandas_udf("array<struct<bucket: int, guest: boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(), "right") - 1
        return pd.Series([[{"bucket": b, "guest": False}] + ([{"bucket": (b - 1) % len(bounds), "guest": True}] if first else [])
                          for b, first in zip(own.tolist(), (bounds[own] == ids.to_numpy()).tolist())])

    dealt = rows.select("doc_id", "text", F.inline(places("doc_id")))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BUCKET) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bucket = None, None
        for rows in batches:
            made = []
            for b, guest, i, text in zip(rows["bucket"].tolist(), rows["guest"].tolist(), rows["doc_id"].tolist(), rows["text"].tolist()):
                if b != bucket:
                    last, bucket = None, b
                if guest and last is None:  # repeated rows of the next bucket's first id
                    continue
                now = _Document(i, text)
                if last is not None:
                    edited, bins = last.edited(now.text)
                    made.append((last.doc_id, len(last.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                 packed(last.bins), packed(bins), likeness(last.bins, bins), likeness(last.bins, now.bins)))
                last = None if guest else now
            yield pd.DataFrame(made, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                              "near_edited", "near_next"])

    found = _with_successors(id_and_text(docs, id_col, text_col), size).mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
             "near_edited double, near_next double")
    return null_ids(found)
