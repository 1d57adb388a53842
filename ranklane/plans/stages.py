"""Composed stages (the reference's entry points) built from the operators.

A stage is an object whose outputs are DataFrames built on first access;
the caller decides what to materialise (``ranklane.sources.formats.materialize``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.functions.constants import NEGATIVE_COUNT, SEED
from ranklane.operators import qrels as qr
from ranklane.operators import retrieval
from ranklane.sources.tables import Collection


def declared_languages(docs: DataFrame):
    """Language tables from the pages' declared ``<html lang>``: the same
    shape the detector produces (title and text share the page label)."""
    doc_lang = docs.select("doc_id", F.col("lang").alias("title_language"),
                           F.col("lang").alias("text_language"))
    query_lang = docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("text_language"))
    return doc_lang, query_lang


class JudgementStage:
    """Entry A: language filter → BM25 top-k → sampled queries → judgements.

    Outputs are built on first access, so asking for the kept ids does not
    run the retrieval's scalar jobs (k, index statistics)."""

    def __init__(self, coll: Collection, doc_lang: DataFrame, query_lang: DataFrame,
                 labels=("en",), negatives: int = NEGATIVE_COUNT,
                 query_limit: int | None = None, seed: int = SEED):
        self.coll, self.labels = coll, list(labels)
        self.doc_lang, self.query_lang = doc_lang, query_lang
        self.negatives, self.query_limit, self.seed = negatives, query_limit, seed

    @cached_property
    def parsed(self):
        """Documents that are to be kept in memory, parsed by all tasks: the
        probe for one row that comes first would have one task parse a whole part."""
        return self.coll.docs.count() if self.coll.docs.storageLevel.useMemory else None

    @cached_property
    def kept_docs(self):
        _ = self.parsed
        return qr.check_nonempty(qr.filter_docs_by_lang(self.doc_lang, self.labels), "documents")

    @cached_property
    def kept_queries(self):
        _ = self.parsed
        return qr.check_nonempty(qr.filter_queries_by_lang(self.query_lang, self.labels), "queries")

    @cached_property
    def qrels(self):
        return qr.filter_qrels(self.coll.qrels, self.kept_queries, self.kept_docs)

    @cached_property
    def queries_with_positives(self):
        return qr.queries_with_positives(self.qrels, self.kept_queries)

    @cached_property
    def queries(self):
        return qr.nonempty_queries(qr.query_lookup(self.queries_with_positives, self.coll.queries))

    @cached_property
    def docs(self):
        return self.coll.docs.join(self.kept_docs, "doc_id", "left_semi")

    @cached_property
    def ranked(self):
        from pyspark import StorageLevel
        k = qr.max_positive_count(qr.relevant_doc_counts(self.qrels)) + self.negatives
        # bounded by queries × k and read twice (queries with hits, then the
        # rankings of the chosen ones): kept instead of recomputing retrieval
        ranked = retrieval.bm25_topk(self.docs, self.queries, k).persist(StorageLevel.MEMORY_AND_DISK)
        return retrieval.rank_sampled_queries(ranked, self.queries, self.query_limit, self.seed)

    @cached_property
    def negatives_topn(self):
        return qr.negatives_topn(self.ranked, self.qrels, self.negatives)

    @cached_property
    def judgements(self):
        return qr.attach_qrels(self.ranked, self.qrels, self.negatives)

    def __getitem__(self, name):
        return getattr(self, {"negatives": "negatives_topn"}.get(name, name))


def judgements_stage(coll: Collection, doc_lang: DataFrame, query_lang: DataFrame, **kw) -> JudgementStage:
    return JudgementStage(coll, doc_lang, query_lang, **kw)
