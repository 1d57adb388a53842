"""Language identification as a Spark job.

Training: character trigrams of the whole labelled texts, counted per
(label, gram) with map-side partial aggregation; add-one log-probabilities.
Application: a text's gram counts are joined to the profile on ``gram``;
score(label) = total_grams · default(label) + Σ tf · (logp − default), so
unseen grams need no row. The label with the best score wins (ties → the
smaller label). Empty text gets ``""``, which never matches a target label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.functions.text import char_grams
from ranklane.operators.common import one_row


def train_profile(labelled: DataFrame, n: int = 3) -> DataFrame:
    """(label, gram, logp, default) from ``labelled(text, label)``."""
    from pyspark import StorageLevel
    # read by the vocabulary count and by the profile itself
    grams = (labelled.select("label", F.explode(char_grams("text", n)).alias("gram"))
             .groupBy("label", "gram").agg(F.count("*").alias("c"))).persist(StorageLevel.MEMORY_AND_DISK)
    totals = grams.groupBy("label").agg(F.sum("c").alias("n_label"))
    v = one_row(grams.agg(F.count_distinct("gram").alias("v")))["v"]
    # one row per label: bounded by the class count
    prof = grams.join(F.broadcast(totals), "label")
    denom = F.col("n_label") + F.lit(v)
    return prof.select("label", "gram", F.ln((F.col("c") + 1) / denom).alias("logp"),
                       F.ln(F.lit(1.0) / denom).alias("default"))


def label_defaults(profile: DataFrame) -> DataFrame:
    return profile.groupBy("label").agg(F.first("default").alias("default"))


def _scored(fields: DataFrame, profile: DataFrame, n: int) -> DataFrame:
    """(__id, __f, label) for (__id, __f, __t): the best label of each text.

    The profile has one row per gram with a score column per label (labels are
    bounded by the class count), so a text's grams meet it once and are summed
    per text in the same pass, for all labels and fields together."""
    defaults = {r["label"]: r["default"] for r in label_defaults(profile).collect()}
    labels = sorted(defaults)
    none = F.lit(None).cast("string")
    if not labels:
        return fields.select("__id", "__f", none.alias("label"))
    wide = profile.groupBy("gram").agg(*[
        F.sum(F.when(F.col("label") == x, F.col("logp") - F.col("default"))).alias(f"d{i}") for i, x in enumerate(labels)])
    grams = (fields.where(F.length(F.trim(F.coalesce("__t", F.lit("")))) > 0)
             .select("__id", "__f", F.explode(char_grams("__t", n)).alias("gram")))
    total = F.count("*")
    sums = grams.join(wide, "gram", "left").groupBy("__id", "__f").agg(*[
        (total * F.lit(defaults[x]) + F.coalesce(F.sum(f"d{i}"), F.lit(0.0))).alias(f"s{i}") for i, x in enumerate(labels)])
    # the highest score, the first label on ties
    best = F.array_max(F.array(*[F.struct(F.round(f"s{i}", 6).alias("s"), F.lit(-i).alias("i"), F.lit(x).alias("label"))
                                 for i, x in enumerate(labels)]))
    return sums.select("__id", "__f", best["label"].alias("label"))


def detect(texts: DataFrame, profile: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           out_col: str = "text_language", n: int = 3) -> DataFrame:
    """(id, out_col) for every row of ``texts``; blank texts give ''."""
    return _detected(texts, profile, id_col, {text_col: out_col}, n)


def _detected(texts: DataFrame, profile: DataFrame, id_col: str, out_of: dict[str, str], n: int = 3) -> DataFrame:
    ids = texts.select(F.col(id_col).alias("__id"))
    fields = texts.select(F.col(id_col).alias("__id"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("__f"), F.col(c).cast("string").alias("__t")) for c in out_of])))
    best = _scored(fields, profile, n).groupBy("__id").agg(*[
        F.max(F.when(F.col("__f") == c, F.col("label"))).alias(out) for c, out in out_of.items()])
    return ids.join(best, "__id", "left").select(
        F.col("__id").alias(id_col), *[F.coalesce(out, F.lit("")).alias(out) for out in out_of.values()])


def detect_doc_languages(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_lang(doc_id, title_language, text_language), both in one pass."""
    return _detected(docs, profile, "doc_id", {"title": "title_language", "text": "text_language"})


def detect_query_languages(queries: DataFrame, profile: DataFrame) -> DataFrame:
    """query_lang(query_id, text_language)."""
    return detect(queries, profile, "query_id", "text", "text_language")
