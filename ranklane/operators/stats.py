"""Term bags and collection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import is_valid_of_tokens, let, shorten_text, term_bag, tokenize, valid_tokens
from ranklane.operators.common import one_row

FIELDS = ("title", "text")

#: values whose spread is within this share of their size are one value
SAME_VALUE = 1e-9


def is_constant(least, most):
    """Whether the least and the largest of some values differ by no more than
    what sums in another order leave. Decides where a deviation is none: a
    deviation of such values is rounding noise, and differs from run to run."""
    return (most - least) <= F.lit(SAME_VALUE) * F.greatest(F.abs(least), F.abs(most))


def field_token_arrays(docs: DataFrame, fields=FIELDS, limit: int | None = None) -> DataFrame:
    """(doc_id, field, tokens ARRAY) — one row per document field (P8 + P9),
    of the whole field unless a ``limit`` of characters is asked for.
    Empty or NULL fields keep a row with an empty array (they count in dn)."""
    rows = []
    for f in fields:
        src = shorten_text(f, limit) if limit else F.col(f)
        rows.append(F.struct(F.lit(f).alias("field"), tokenize(src).alias("tokens")))
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("ft")).select(
        "doc_id", F.col("ft.field").alias("field"), F.col("ft.tokens").alias("tokens"))


def term_bags(field_tokens: DataFrame, valid: bool = False, stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, field, n_tokens, bag): the term bag of each document field as
    one array on its row. Counting is row-local, so no term is shuffled."""
    tokens = valid_tokens("tokens", stop_words) if valid else F.col("tokens")
    return field_tokens.select("doc_id", "field", F.size(tokens).alias("n_tokens"), term_bag(tokens).alias("bag"))


def valid_bags(bags: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """The valid-term bags within bags of all tokens that ``tokenize`` made:
    distinct terms are tested, not tokens."""
    n = lambda bag: F.aggregate(bag, F.lit(0).cast("long"), lambda n, e: n + e["tf"]).cast("int")
    kept = let(F.filter("bag", lambda e: is_valid_of_tokens(e["term"], stop_words)),
               lambda bag: F.struct(n(bag).alias("n_tokens"), bag.alias("bag")))
    return bags.select("doc_id", "field", kept.alias("kept")).select("doc_id", "field", "kept.n_tokens", "kept.bag")


def term_freq(field_tokens: DataFrame) -> DataFrame:
    """All-token bag per field (A4): (doc_id, field, term, tf)."""
    return term_bags(field_tokens).select("doc_id", "field", F.inline("bag"))


def valid_term_freq(field_tokens: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Valid-token bag per field (A5): (doc_id, field, term, tf)."""
    return term_bags(field_tokens, True, stop_words).select("doc_id", "field", F.inline("bag"))


def collection_stats(field_tokens: DataFrame):
    """Collection statistics (A6) over every field as one document.

    Returns ``(term_stats, coll)``: ``term_stats(term, df, cf)``, written once
    to the checkpoint folder, and a dict ``{dn, cn, vocab, avgdlen}``. ``dn``
    counts fields, empty ones included; ``cn`` counts all tokens. One pass over
    the texts and one shuffle of pre-aggregated terms: each field adds a row
    without a term that carries its number of tokens, so the group without a
    term holds ``dn`` and ``cn``.
    """
    return stats_of_bags(term_bags(field_tokens))


def stats_of_bags(bags: DataFrame):
    """``collection_stats`` from the bags of all tokens."""
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n_tokens").cast("long").alias("tf")))
    rows = bags.select(F.inline(F.concat(own, "bag")))
    counted = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).checkpoint(eager=True)
    term_stats = counted.where(F.col("term").isNotNull())
    whole = counted.where(F.col("term").isNull()).first()
    coll = {"dn": whole["df"] if whole else 0, "cn": whole["cf"] if whole else 0}
    coll["vocab"] = one_row(term_stats.agg(F.count("*").alias("vocab")))["vocab"]
    coll["avgdlen"] = coll["cn"] / coll["dn"] if coll["dn"] else 0.0
    return term_stats, coll


def sld_counts(docs_with_sld: DataFrame) -> DataFrame:
    """Documents per registrable domain."""
    return docs_with_sld.groupBy("sld").agg(F.count("*").alias("n"))


def standard_scale(df: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """Population z-score per column; a constant column scales by 1.
    Statistics are one global aggregate joined back as a one-row table."""
    st = one_row(df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(value_cols)],
                        *[F.when(~is_constant(F.min(c), F.max(c)), F.stddev_pop(c)).alias(f"s_{i}")
                          for i, c in enumerate(value_cols)]))
    cols = [F.col(key)]
    for i, c in enumerate(value_cols):
        s = st[f"s_{i}"]
        s = 1.0 if (s is None or s == 0) else s
        cols.append(((F.col(c) - F.lit(st[f"m_{i}"])) / F.lit(s)).alias(c))
    return df.select(*cols)


def zscore_per_query(long_features: DataFrame, keys=("query_id",)) -> DataFrame:
    """Per-list z-score (A22) on the long form (…keys, doc_id, idx, value):
    sample deviation per (list, feature); constant values or one alone → 0."""
    w = Window.partitionBy(*keys, "idx")
    mean = F.avg("value").over(w)
    sd = F.stddev_samp("value").over(w)
    flat = is_constant(F.min("value").over(w), F.max("value").over(w))
    return long_features.withColumn(
        "z", F.when(sd.isNull() | flat, F.lit(0.0)).otherwise((F.col("value") - mean) / sd))
