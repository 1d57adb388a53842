"""Query domains: query vectors, clustering, splits, dataset division
(A9-A14, W3-W6, M6-M7, J13, U1).

Features travel in wide form (``f0 … f{n-1}`` DOUBLE columns) so every
statistic is a plain column aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.functions.constants import SEED, TRAIN_RATE, VALID_RATE
from ranklane.functions.text import seeded_bucket, seeded_hash_order
from ranklane.operators.common import one_row
from ranklane.operators.ordering import global_position


def fcols(df: DataFrame, prefix: str = "f") -> list[str]:
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return sorted(cols, key=lambda c: int(c[len(prefix):]))


def query_mean_features(features: DataFrame, keys=("query_id",)) -> DataFrame:
    """Mean feature vector per query."""
    cols = fcols(features)
    return features.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def select_features(df: DataFrame, idx: list[int], keep=("query_id",)) -> DataFrame:
    """Feature-subset projection on the wide form (P15); unknown indices are skipped."""
    have = set(fcols(df))
    return df.select(*keep, *[F.col(f"f{i}") for i in idx if f"f{i}" in have])


def equal_freq_domains(values: DataFrame, k: int, key: str = "query_id", value: str = "value") -> DataFrame:
    """Equal-frequency bins over one value (W3): rows ordered by (value, key);
    bins 0..k-1; the first ``n % k`` bins get one extra row. Positions come
    from a range-partitioned global order (no single-task window)."""
    v = values.select(key, F.round(F.col(value), 9).alias("__v"))
    pos = global_position(v, [F.col("__v"), F.col(key)])
    n = one_row(values.agg(F.count("*").alias("n")))["n"]
    q, r = divmod(n, k)
    p = F.col("pos")
    big = r * (q + 1)
    if q == 0:
        bin_ = p - 1
    else:
        bin_ = F.when(p <= big, F.floor((p - 1) / (q + 1))).otherwise(
            F.lit(r) + F.floor((p - 1 - big) / q))
    return pos.select(key, bin_.cast("int").alias("domain_id"))


def random_domains(ids: DataFrame, k: int, seed: int = SEED, key: str = "query_id") -> DataFrame:
    """Seeded pseudo-random domain per query (M6), identical in DuckDB."""
    return ids.select(key, seeded_bucket(F.col(key), seed, k).cast("int").alias("domain_id"))


#: fits side by side; each holds k centres on the driver
FITS_AT_ONCE = 10


def kmeans_domains(vectors: DataFrame, k: int, seeds=range(10), key: str = "query_id",
                   max_iter: int = 50) -> DataFrame:
    """K-means on the (already scaled) vectors (M7); Spark ML has no n_init,
    so ``len(seeds)`` fits run and the lowest training cost is kept. A fit is
    a chain of small jobs, most of it waiting: fits run side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    cols = fcols(vectors)
    data = VectorAssembler(inputCols=cols, outputCol="__x").transform(vectors).select(key, "__x").cache()

    def fit(s):
        model = KMeans(k=k, seed=int(s), featuresCol="__x", maxIter=max_iter).fit(data)
        return model, model.summary.trainingCost

    data.count()  # in memory before the fits begin
    seeds = list(seeds)
    with ThreadPoolExecutor(max_workers=max(1, min(len(seeds), FITS_AT_ONCE))) as ex:
        fits = list(ex.map(fit, seeds))
    best = min(fits, key=lambda f: f[1])[0]  # the first of equals
    out = best.transform(data).select(key, F.col("prediction").cast("int").alias("domain_id"))
    return out


def domain_members(assign: DataFrame, key: str = "query_id") -> DataFrame:
    """The members of each domain, one row per member (A12): a domain with a
    large share of all queries is no oversized row."""
    return assign.select("domain_id", key).distinct()


def rank_within(df: DataFrame, group: str, order: list, out: str = "rn") -> DataFrame:
    """1-based rank inside each group by ``order`` without a per-group
    window: one global range-partitioned order on (group, order), minus the
    group's first position (a table with one row per group)."""
    pos = global_position(df, [F.col(group), *order], out="__pos")
    first = pos.groupBy(group).agg(F.min("__pos").alias("__first"), F.count("*").alias("__n"))
    return pos.join(F.broadcast(first), group).withColumn(out, F.col("__pos") - F.col("__first") + 1) \
        .drop("__pos", "__first")


def split_queries(assign: DataFrame, train_rate: float = TRAIN_RATE, valid_rate: float = VALID_RATE,
                  seed: int = SEED, key: str = "query_id") -> DataFrame:
    """Seeded split inside each domain (W4): train = max(1, ⌊n·t⌋),
    valid = min(⌊n·v⌋, n − train), rest test (rates as DOUBLE)."""
    r = rank_within(assign.withColumn("__h", seeded_hash_order(F.col(key), seed)), "domain_id",
                    [F.col("__h"), F.col(key)])
    n = F.col("__n")
    train = F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(float(train_rate))))
    valid = F.least(F.floor(n.cast("double") * F.lit(float(valid_rate))), n - train)
    step = (F.when(F.col("rn") <= train, F.lit("train"))
            .when(F.col("rn") <= train + valid, F.lit("valid")).otherwise(F.lit("test")))
    return r.select(key, "domain_id", step.alias("step"))


def split_domains(spark, n_domains: int, train_rate: float = TRAIN_RATE, valid_rate: float = VALID_RATE,
                  seed: int = SEED) -> DataFrame:
    """Exact-count step per domain id 0..n-1 in seeded order (W5); domains
    without queries still get a step."""
    n_train = int(n_domains * train_rate)
    n_valid = int(n_domains * valid_rate)
    d = spark.range(n_domains).select(F.col("id").cast("int").alias("domain_id"))
    r = global_position(d.withColumn("__h", seeded_hash_order(F.col("domain_id"), seed)),
                        [F.col("__h"), F.col("domain_id")], n_parts=1)
    step = (F.when(F.col("pos") <= n_train, F.lit("train"))
            .when(F.col("pos") <= n_train + n_valid, F.lit("valid")).otherwise(F.lit("test")))
    return r.select("domain_id", step.alias("meta_step"))


def divide_dataset(features: DataFrame, query_split: DataFrame, domain_split: DataFrame,
                   idx: list[int]) -> DataFrame:
    """(meta_step, domain_id, step, relevance, query_id, doc_id, s0…).
    Both lookups are keyed joins. A query without a domain, or a domain
    without a step, is an error, not a dropped row."""
    sub = features.select("relevance", "query_id", "doc_id",
                          *[F.col(f"f{i}").alias(f"s{k}") for k, i in enumerate(idx)])
    found = query_split.join(domain_split, "domain_id", "left").select(
        "query_id", "step", "domain_id", "meta_step")
    j = sub.join(found, "query_id", "left")

    def known(c):
        missing = F.raise_error(F.concat(F.lit(f"no {c} for query "), F.col("query_id")))
        return F.when(F.col(c).isNull(), missing.cast(found.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return j.select(known("meta_step"), known("domain_id"), "step", "relevance", "query_id", "doc_id",
                    *[f"s{k}" for k in range(len(idx))])


def domain_features(divided: DataFrame, positive_only: bool = False, keep=None) -> DataFrame:
    """Domain vector = mean over queries of the per-query mean.
    ``keep`` (plug-in X3) is a Column predicate on the rows to use."""
    d = divided
    if positive_only:
        d = d.where((F.col("relevance") > 0) & F.col("step").isin("train", "valid"))
    if keep is not None:
        d = d.where(keep)
    cols = fcols(d, "s")
    per_q = d.groupBy("meta_step", "domain_id", "query_id").agg(*[F.avg(c).alias(c) for c in cols])
    return per_q.groupBy("meta_step", "domain_id").agg(*[F.avg(c).alias(c) for c in cols])


def global_dataset(divided: DataFrame) -> DataFrame:
    """All domains of each meta step as one dataset."""
    return divided.drop("domain_id")


# plug-in X2: ways to make a domain's vector, by name
DOMAIN_VECTORS = {
    "all_rows": domain_features,
    "positive_rows": lambda divided: domain_features(divided, positive_only=True),
}


def domain_vectors(method: str, divided: DataFrame) -> DataFrame:
    """Domain vectors by a registered method; an unknown name raises."""
    if method not in DOMAIN_VECTORS:
        raise ValueError(f"unknown domain vectors: {method}")
    return DOMAIN_VECTORS[method](divided)


def cluster(method: str, vectors: DataFrame, k: int, key: str = "query_id", seed: int = SEED) -> DataFrame:
    """Plug-in X7: clustering by name. ``equal_freq`` needs a one-column
    vector; an unknown name raises."""
    if method == "random":
        return random_domains(vectors.select(key), k, seed, key)
    if method == "kmeans":
        return kmeans_domains(vectors, k, key=key)
    if method == "equal_freq":
        cols = fcols(vectors)
        if len(cols) != 1:
            raise ValueError("equal_freq clustering needs exactly one feature")
        return equal_freq_domains(vectors.select(key, F.col(cols[0]).alias("value")), k, key)
    raise ValueError(f"unknown clustering method: {method}")
