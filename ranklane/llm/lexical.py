"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are indexed in blocks: a row of the index holds the documents of a
block, its sorted terms, and each term's documents and frequencies. A search
never moves postings. Every task reads its blocks, builds the impact lists of
the queries' terms (a term's documents by falling contribution to a score) and
finds the best ``k`` documents of each query with the Best Position Algorithm:

* sorted access reads all lists of a query side by side, from the top;
* each document met is looked up in all lists (direct access), which gives its
  whole score and its position in every list;
* a list's best position is the end of the unbroken run of positions seen,
  whichever way they were seen. No document that is still unseen can score
  more than the sum of what the lists hold right after their best positions;
* reading stops when that sum is strictly below the k-th score, so documents
  that tie with the k-th are all met.

The k-th score found in a task's earlier blocks already bounds the later ones.
Only ``k`` rows a query and task leave a task; they are merged by query.

Queries are taken in slices of ``SLICE`` bytes of terms, so the part of a query
set that a task holds is bounded, and any number of queries can be asked.

Weights are integers: a term in ``df`` of ``N`` documents weighs
``floor(1000 ln((2N+2)/(2df+1)))``, a document of ``n`` of the collection's ``L``
terms has ``m = 75 + 25nN div L``, and a term found ``tf`` times adds
``w (1000000000 tf div (1000 tf + 12 m))``. Terms are the maximal runs of ASCII
letters, digits and non-ASCII characters; only A-Z are lower-cased.

Defined cases: a text that is null, or has no term, is no document and is no
query; rows that share an id are documents (and queries) of their own; a null
id takes part and comes after all others among equal scores; fewer than ``k``
documents with a score above 0 give fewer rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import NO_ID, id_and_text, null_ids, written

TOP = 20
#: bytes of text a block of the index, about (or one longer text)
BLOCK = 16 << 20
#: bytes of queries' terms that are asked at once, about (or one longer query)
SLICE = 4 << 20
#: positions that the first round reads of each list; later rounds read twice as many
FIRST_READ = 32
_PIECE = 1 << 20
#: other bytes than those of a term become blanks, A-Z small
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of those of about a megabyte."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _block_row(ids: list[int], vocabulary: dict[bytes, int], found: list[np.ndarray]) -> pd.DataFrame:
    """An index row of documents (their ids, and the terms' numbers in each)."""
    lengths = np.array([len(f) for f in found], np.int64)
    pairs = np.concatenate(found).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    pairs, tf = np.unique(pairs, return_counts=True)  # by term, then by document
    terms = sorted(vocabulary)
    place = np.array([vocabulary[t] for t in terms], np.int64)
    df = np.bincount(pairs // len(ids), minlength=len(terms))
    start = np.concatenate([[0], np.cumsum(df)])
    # terms' postings in the order of the sorted terms
    sizes = df[place]
    take = np.repeat(start[place] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(pairs))
    return pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "lengths": [lengths.tobytes()],
                         "terms": [zstandard.compress(b" ".join(terms), 3)], "dfs": [_pack(sizes.astype(np.int32))],
                         "docs": [_pack((pairs % len(ids))[take].astype(np.int32))], "tfs": [_pack(tf[take].astype(np.int32))],
                         "n_docs": [len(ids)], "n_terms": [int(lengths.sum())]})


INDEX = "ids binary, lengths binary, terms binary, dfs binary, docs binary, tfs binary, n_docs long, n_terms long"


def block_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The index: a row for each block of about ``size`` bytes of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vocabulary, found, held = [], {}, [], 0
        for rows in batches:
            for i, text in zip(rows["doc_id"].tolist(), rows["text"].tolist()):
                if held and held + len(text or "") > size:
                    yield _block_row(ids, vocabulary, found)
                    ids, vocabulary, found, held = [], {}, [], 0
                number = vocabulary.setdefault
                parts = [np.fromiter((number(t, len(vocabulary)) for t in part), np.int32, len(part))
                         for part in terms_of(text) if part]
                if parts:
                    ids.append(i)
                    found.append(np.concatenate(parts))
                    held += len(text)
        if ids:
            yield _block_row(ids, vocabulary, found)

    return id_and_text(docs, id_col, text_col).mapInPandas(run, INDEX)


def _block_terms(r) -> list[bytes]:
    return zstandard.decompress(r.terms).split(b" ")


def document_frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """df of each of ``terms`` (those of one slice) that is in the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for rows in batches:
            for r in rows.itertuples():
                df = _unpack(r.dfs, np.int32)
                for i, t in enumerate(_block_terms(r)):
                    if t in terms:
                        counts[t] += int(df[i])
        yield pd.DataFrame({"term": list(counts), "df": list(counts.values())})

    counted = index.select("terms", "dfs").mapInPandas(run, "term binary, df long")
    return {bytes(r.term): r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class ImpactList:
    """A term's documents in a block, by falling impact and by document."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        order = np.argsort(-impacts, kind="stable")
        self.sorted_docs, self.sorted_impacts = docs[order], impacts[order]
        self.docs, self.impacts = docs, impacts  # by document, for direct access
        self.position = np.empty(len(docs), np.int64)
        self.position[order] = np.arange(len(docs))


def best_positions(lists: list[tuple[int, ImpactList]], n_docs: int, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents read) of a block: all documents that can
    be among the ``k`` best if ``bound`` is the k-th score known so far (0: none).
    ``lists``: a query's terms as (occurrences in the query, impact list)."""
    seen = [np.zeros(len(x.docs) + 1, bool) for _, x in lists]  # the last place is never seen
    best = [0] * len(lists)
    met = np.zeros(n_docs, bool)
    docs, scores = [], []
    depth, read, longest = 0, FIRST_READ, max(len(x.docs) for _, x in lists)
    while True:
        fresh = np.zeros(n_docs, bool)
        for _, x in lists:
            fresh[x.sorted_docs[depth:depth + read]] = True
        new = np.flatnonzero(fresh & ~met)
        if len(new):
            met[new] = True
            total = np.zeros(len(new), np.int64)
            for (times, x), marks in zip(lists, seen):
                at = np.searchsorted(x.docs, new)
                at[at == len(x.docs)] = 0
                hit = x.docs[at] == new
                at = at[hit]
                total[hit] += times * x.impacts[at]
                marks[x.position[at]] = True
            docs.append(new)
            scores.append(total)
            every = np.concatenate(scores)
            if len(every) >= k:
                bound = max(bound, int(np.partition(every, len(every) - k)[len(every) - k]))
        depth, read = depth + read, read * 2
        threshold = 0
        for i, (times, x) in enumerate(lists):
            best[i] += int(np.argmin(seen[i][best[i]:]))
            if best[i] < len(x.docs):
                threshold += times * int(x.sorted_impacts[best[i]])
        if threshold == 0 or depth >= longest or threshold < bound:
            break
    return np.concatenate(docs), np.concatenate(scores), int(met.sum())


def _search_slice(index: DataFrame, queries: list[tuple[int, int, Counter]], n: int, total: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best ``k`` of each query and task.
    ``queries``: (number, item id, terms with occurrences)."""
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
               for t, df in document_frequencies(index, {t for _, _, c in queries for t in c}).items()}
    asked = [(q, i, [(t, times) for t, times in c.items() if weights.get(t)]) for q, i, c in queries]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        top = {q: (none, none) for q, _, _ in asked}  # scores and ids, best first
        for rows in batches:
            for r in rows.itertuples():
                ids, lengths = np.frombuffer(r.ids, np.int64), np.frombuffer(r.lengths, np.int64)
                norm = 12 * (75 + (25 * lengths * n) // total)
                bounds = np.concatenate([[0], np.cumsum(_unpack(r.dfs, np.int32), dtype=np.int64)])
                docs, tfs = _unpack(r.docs, np.int32), _unpack(r.tfs, np.int32)
                lists = {}
                for i, t in enumerate(_block_terms(r)):
                    if weights.get(t):
                        at, tf = docs[bounds[i]:bounds[i + 1]], tfs[bounds[i]:bounds[i + 1]].astype(np.int64)
                        lists[t] = ImpactList(at, weights[t] * ((1_000_000_000 * tf) // (1000 * tf + norm[at])))
                for q, _, c in asked:
                    own = [(times, lists[t]) for t, times in c if t in lists]
                    if not own:
                        continue
                    scores, names = top[q]
                    bound = int(scores[-1]) if len(scores) == k else 0
                    found, made, _ = best_positions(own, len(ids), k, bound)
                    use = made >= max(bound, 1)
                    if use.any():
                        scores, names = np.concatenate([scores, made[use]]), np.concatenate([names, ids[found[use]]])
                        by = np.lexsort((np.where(names == NO_ID, np.iinfo(np.int64).max, names), -scores))[:k]
                        top[q] = (scores[by], names[by])
        for q, i, _ in asked:
            scores, names = top[q]
            if len(scores):
                yield pd.DataFrame({"query": q, "item_id": i, "doc_id": names, "score": scores})

    return index.mapInPandas(run, "query long, item_id long, doc_id long, score long")


def _slices(items: DataFrame, size: int) -> Iterator[list[tuple[int, int, Counter]]]:
    """Queries in slices of about ``size`` bytes of distinct terms."""
    now, held = [], 0
    for number, r in enumerate(items.toLocalIterator()):
        terms: Counter = Counter()
        for part in terms_of(r.text):
            terms.update(part)
        if not terms:
            continue
        now.append((number, r.doc_id, terms))
        held += sum(map(len, terms)) + 16 * len(terms)
        if held >= size:
            yield now
            now, held = [], 0
    if now:
        yield now


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, slice_bytes: int = SLICE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    index = written(block_index(docs, id_col, text_col, block), "lexical-index")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = spark.createDataFrame([], "query long, item_id long, doc_id long, score long")
    if n:
        for queries in _slices(id_and_text(items, item_col, item_text), slice_bytes):
            found = found.union(written(_search_slice(index, queries, n, total, k), "lexical-top"))
    found = null_ids(found)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # two steps, so that a query's rows of all tasks do not meet in one task at once
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("query", "part").orderBy(*best))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select(F.nullif("item_id", F.lit(NO_ID)).alias("item_id"), F.col("rank").cast("int"), "doc_id", "score")


_TERMS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format(text="text")} AS terms FROM documents),
size AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
coll AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
post AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT item, item_id, term, count(*) AS times FROM (
        SELECT row_number() OVER () AS item, item_id, unnest({_TERMS.format(text="text")}) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM post, coll WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM q JOIN weight USING (term) JOIN post USING (term) JOIN size USING (row), coll GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
