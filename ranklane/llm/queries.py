"""Queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.llm import (bpe, decontaminate, langid, lexical, minhash, quality, sharding, simhash, suffix_dedup, token_store,
                          toxicity, warc, whitening)
from ranklane.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op9_simhash_pivots")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_suffix_merge")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_language_backoff")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op10_spaced_seeds", decontaminate.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), min_item=1)


@query("op1_quality_ledger", quality.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(read_table(spark, sf_dir, "documents"))
    base, corpus = quality.BASE, quality.policy("corpus", 1)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~quality.passes(base)).alias("base_failed"), quality.passes(corpus).alias("kept"), "failed")


@query("quality_ablations")
def op1_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(read_table(spark, sf_dir, "documents")))


@query("op2_segment_tree_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_output=False)


@query("op5_differencing_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced_shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op7_seekable_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.token_digests(token_store.read_tokens(manifest))


@query("op6_warc_ranges")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))


@query("op4_toxicity_trees")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op11_cholesky_jacobi_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op12_one_permutation_minhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op13_best_position", lexical.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
