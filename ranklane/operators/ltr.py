"""Linear rankers: z-scoring, scoring, and coordinate ascent.

Coordinate ascent (Metzler & Croft 2007) with an exact line search, as Spark
jobs. Along one weight every score of a list is a line, so NDCG@k is a step
function: it changes only where a document with a gain meets another one. Each
list gives its steps as events (place on the line, change of the mean), the
events of a model are summed and swept, and every stretch between two events is
tried, not a grid of step sizes. All models and restarts take a coordinate in
one job of two stages: lists, held as arrays by list length, give their events;
groups of events of like size meet in a task, which sweeps them. Only a group's
sum and the places that can be its best reach the driver, which holds the
weights (models x restarts x features).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.functions.constants import CUTOFF, SEED
from ranklane.operators.stats import SAME_VALUE

# tasks get these functions with their code: no executor needs the package for them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def to_long(divided: DataFrame, keys: list[str], prefix: str = "s") -> DataFrame:
    """Wide s0..s{n-1} → (…keys, query_id, doc_id, relevance, idx, value)."""
    from ranklane.operators.domains import fcols
    cols = fcols(divided, prefix)
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return divided.select(*keys, "query_id", "doc_id", "relevance",
                          F.posexplode(arr).alias("idx", "value"))


#: lists whose z-scores are worked out at once
LISTS_AT_ONCE = 1024


def _zscores(x: np.ndarray, null: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z-scores of rows that lie list by list, and which of them are null, by
    the rules of ``stats.zscore_per_query`` (nulls are no values)."""
    starts, row = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    with np.errstate(all="ignore"):
        n = np.add.reduceat(~null, starts, dtype=float)
        off = x - (np.add.reduceat(np.where(null, 0.0, x), starts) / n)[row]
        sd = np.sqrt(np.add.reduceat(np.where(null, 0.0, off * off), starts) / (n - 1))
        low = np.minimum.reduceat(np.where(null, np.inf, x), starts)
        high = np.maximum.reduceat(np.where(null, -np.inf, x), starts)
        same = (high - low <= SAME_VALUE * np.maximum(np.abs(low), np.abs(high))) | np.isnan(high) | (n < 2)
        return np.where(same[row], 0.0, off / sd[row]), null & ~same[row]


def list_zscores(names: list[str], cols: list[str]):
    """Lists (…names, docs ARRAY<STRUCT<doc_id, relevance, z>>) → a row per
    document with the z-scores of its list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LISTS_AT_ONCE):
                part = batch.slice(at, LISTS_AT_ONCE)
                lists = part.column("docs")
                row, docs = pc.list_parent_indices(lists), pc.list_flatten(lists)
                flat = pc.list_flatten(docs.field("z"))
                x = flat.to_numpy(zero_copy_only=False).reshape(-1, len(cols))
                null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(cols))
                z, none = _zscores(x, null, np.bincount(row.to_numpy(zero_copy_only=False), minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(row) for c in names], docs.field("doc_id"), docs.field("relevance"),
                     *[pa.array(z[:, i], mask=none[:, i]) for i in range(len(cols))]],
                    names=[*names, "doc_id", "relevance", *cols])
    return run


def zscore_wide(divided: DataFrame, keys: list[str], prefix: str = "s") -> DataFrame:
    """Per-list z-score of every feature column (A22, sample deviation;
    constant values or one alone → 0); wide in, wide out. A list (one query's
    judged documents, see ``query_lists``) is one row on the way; batches of
    lists are scaled as arrays, not by a window function per feature."""
    from ranklane.operators.domains import fcols
    cols, names = fcols(divided, prefix), [*keys, "query_id"]
    if not cols:
        return divided.select(*names, "doc_id", "relevance")
    doc = F.struct("doc_id", "relevance", F.array(*[F.col(c).cast("double") for c in cols]).alias("z"))
    lists = divided.groupBy(*names).agg(F.collect_list(doc).alias("docs"))
    schema = T.StructType([*[divided.schema[c] for c in (*names, "doc_id", "relevance")],
                           *[T.StructField(c, T.DoubleType()) for c in cols]])
    return lists.mapInArrow(list_zscores(names, cols), schema)


def _dot(w, z):
    return F.aggregate(F.zip_with(w, z, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)


def score_wide(z_wide: DataFrame, weights: DataFrame, keys=("domain_id",), prefix: str = "s") -> DataFrame:
    """Linear scores (M10, J18) of every model on every list it applies to.

    ``weights(model, domain_id, idx, w)``: rows with a domain apply to that
    domain only; rows with NULL domain are global models, applied everywhere.
    A model's weights are one array, so a judged row meets each of its models
    once and its score is a row-local dot product: no row per feature, no
    aggregate over judged rows. Global models (a few, each of one array) travel
    as a literal."""
    from ranklane.operators.domains import fcols
    keys = list(keys)
    cols = fcols(z_wide, prefix)
    rows = z_wide.select(*keys, "query_id", "doc_id", "relevance",
                         F.array(*[F.col(c).cast("double") for c in cols]).alias("__z"))
    n = len(cols)
    packed = weights.groupBy("model", "domain_id").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.col("w").cast("double")))).alias("__m"))
    packed = packed.select("domain_id", F.struct("model", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(
        F.try_element_at("__m", i), F.lit(0.0))).alias("__w")).alias("__model"))
    out = ["model", *keys, "query_id", "doc_id", "relevance", _dot(F.col("__w"), F.col("__z")).alias("score")]
    shared = packed.where(F.col("domain_id").isNull()).select("__model.*").collect()
    own = "domain_id" in keys
    if not shared and not own:
        return None
    # all models of a judged row meet it at once: the rows are made once
    models = [F.array(*[F.struct(F.lit(r["model"]).alias("model"), F.lit([float(x) for x in r["__w"]]).alias("__w"))
                        for r in shared])] if shared else []
    if own:
        per_domain = packed.where(F.col("domain_id").isNotNull()).groupBy("domain_id").agg(F.collect_list("__model").alias("__own"))
        rows = rows.join(per_domain, "domain_id", "left" if shared else "inner")
        models.append(F.coalesce("__own", F.array().cast(per_domain.schema["__own"].dataType)))
    return rows.select("*", F.inline(F.concat(*models))).select(*out)


def best_restart(evals: DataFrame, keys=("model",)) -> DataFrame:
    """Arg-max over restarts (A21): highest score, the first restart wins ties."""
    return evals.groupBy(*keys).agg(
        F.max_by("restart", F.struct(F.round("score", 9), -F.col("restart"))).alias("restart"),
        F.max("score").alias("score"))


# ---- coordinate ascent --------------------------------------------------------------

def query_lists(zwide: DataFrame, keys: list[str], n_features: int, k: int = CUTOFF) -> DataFrame:
    """One row per judged list: (…keys, query_id, docs ARRAY<STRUCT<doc_id, rel, z>>, idcg).
    A list holds the judged documents of one query — bounded by construction
    (max positives + negatives), so packing it never gathers an unbounded group."""
    from ranklane.operators.domains import fcols
    cols = fcols(zwide, "s")[:n_features]
    doc = F.struct(F.col("doc_id"), F.col("relevance").cast("double").alias("rel"),
                   F.array(*[F.col(c).cast("double") for c in cols]).alias("z"))
    lists = zwide.groupBy(*keys, "query_id").agg(F.collect_list(doc).alias("docs"))
    gains = F.transform(F.slice(F.sort_array(F.transform("docs", lambda d: d["rel"]), asc=False), 1, k),
                        lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2))
    return lists.withColumn("idcg", F.aggregate(gains, F.lit(0.0), lambda a, x: a + x))


#: stretches of the line shorter than this are rounding noise
MIN_STRETCH = 1e-9


#: least and most lists of a task of the ascent
LISTS_A_TASK, MAX_LISTS = 500, 20_000
#: most numbers of a piece of a block that is worked on at once
PIECE = 1 << 20


def packed_lists(lists: DataFrame, n_parts: int | None = None) -> RDD:
    """Blocks (mk, z[list, doc, feature], gain[list, doc], place[list, doc]) of
    lists of one model and length. ``place`` orders the documents by id; gains
    are shares of the ideal. Lists without a gain have no events."""
    by_id = F.array_sort(F.transform("docs", lambda d: F.struct(d["doc_id"].alias("id"), d["rel"].alias("rel"), d["z"].alias("z"))))
    rows = lists.where("idcg > 0").select("mk", "idcg", by_id.alias("d"))
    rows = rows.select("mk", "idcg", F.transform("d", lambda x: x["rel"]).alias("rel"), F.flatten(F.transform("d", lambda x: x["z"])).alias("z"),
                       F.transform("d", lambda x: F.array_position(F.transform("d", lambda y: y["id"]), x["id"])).alias("place"))
    rows = rows if n_parts is None else rows.repartition(n_parts)

    def blocks(part: Iterator) -> Iterator[tuple]:
        held: dict[tuple, list] = {}
        for r in part:
            held.setdefault((r.mk, len(r.rel)), []).append(
                (np.array(r.z, float), (np.exp2(np.array(r.rel, float)) - 1) / r.idcg, np.array(r.place)))
            if len(held[r.mk, len(r.rel)]) >= 4096:
                yield _block(r.mk, len(r.rel), held.pop((r.mk, len(r.rel))))
        for (mk, n), found in held.items():
            yield _block(mk, n, found)

    return rows.rdd.mapPartitions(blocks)


def _block(mk: str, n: int, found: list) -> tuple:
    z, gain, place = (np.stack(x) for x in zip(*found))
    return mk, z.reshape(len(found), n, -1), gain, place


def _block_events(block: tuple, w: np.ndarray, f: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``w``, delta, dv) of the events of a block's lists, as coordinate
    ``f`` of each row of weights moves by delta. Rows, not pairs, leave a list:
    of a document with a gain, only meetings that change its part of the value."""
    _, z, gain, place = block
    n, models = z.shape[1], len(w)
    discount = np.zeros(n + 2)
    discount[1:k + 1] = 1 / np.log2(np.arange(2, min(k, n + 1) + 2))
    of_list, own = np.nonzero(gain > 0)
    out, step = [], max(1, PIECE // (n * models))
    for at in range(0, len(own), step):
        lst, o = of_list[at:at + step], own[at:at + step]
        lines = z[lst]  # owner, doc, feature
        here = np.arange(len(o))
        b = np.round(lines @ w.T, 9).transpose(0, 2, 1)  # owner, model, doc
        s = np.round(lines[:, :, f], 9).transpose(0, 2, 1)
        ob, os = b[here, :, o][:, :, None], s[here, :, o][:, :, None]
        earlier = (place[lst] < place[lst, o][:, None])[:, None, :]
        first = 1 + np.count_nonzero((s < os) | ((s == os) & ((b > ob) | ((b == ob) & earlier))), axis=2)
        by = np.where(s > os, 1, np.where(s < os, -1, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            delta = np.where(by != 0, (ob - b) / (s - os), np.inf)
        order = np.argsort(by, axis=2, kind="stable")
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(delta, order, 2), axis=2, kind="stable"), 2)
        delta, by = np.take_along_axis(delta, order, 2), np.take_along_axis(by, order, 2)
        after = first[:, :, None] + np.cumsum(by, axis=2)
        g = gain[lst, o][:, None, None]
        dv = g * (discount[after] - discount[after - by])
        model = np.broadcast_to(np.arange(models)[None, :, None], dv.shape)
        kept = dv != 0
        out += [(model[kept], delta[kept], dv[kept]),
                (np.arange(models), np.full(models, -np.inf), (g[:, :, 0] * discount[first]).sum(0))]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0))


def line_events(lists: DataFrame, state: DataFrame, pos: int, k: int = CUTOFF) -> DataFrame:
    """(mk, restart, delta, dv): the steps of the sum of the lists' NDCG@k as
    coordinate number ``pos`` of each model moves by delta from where it is; the
    value far left stands at minus infinity."""
    models: dict[str, list] = {}
    for r in state.where("live").select("mk", "restart", "w", F.col("order")[pos].alias("f")).collect():
        models.setdefault(r.mk, []).append(r)

    def events(block):
        rows = models.get(block[0], [])
        if not rows:
            return []
        row, delta, dv = _block_events(block, np.array([r.w for r in rows]), np.array([r.f for r in rows]), k)
        return [(block[0], rows[i].restart, d, v) for i, d, v in zip(row.tolist(), delta.tolist(), dv.tolist())]

    return lists.sparkSession.createDataFrame(packed_lists(lists).flatMap(events), "mk string, restart int, delta double, dv double")


def stretches(events: DataFrame) -> DataFrame:
    """(mk, restart, delta, value): a place in every stretch between two events,
    as near to 0 as its inner four fifths allow, and the value there. Events are
    swept in groups of like size of delta, whose sums are then added up, so one
    model's events are spread over many tasks."""
    size = F.least(F.greatest(F.round(F.asinh(F.col("delta") * 1000) * 3), F.lit(-64.0)), F.lit(64.0))
    group = F.when(F.col("delta") == float("-inf"), F.lit(-64)).otherwise(size.cast("int"))
    summed = events.withColumn("group", group).groupBy("mk", "restart", "group", "delta").agg(F.sum("dv").alias("dv"))
    inner = Window.partitionBy("mk", "restart", "group").orderBy("delta")
    swept = summed.select("mk", "restart", "group", "delta", F.sum("dv").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("v"),
                          F.lead("delta").over(inner).alias("after"))
    groups = Window.partitionBy("mk", "restart").orderBy("group")
    sums = (summed.groupBy("mk", "restart", "group").agg(F.sum("dv").alias("dv"), F.min("delta").alias("least"))
            .select("mk", "restart", "group", F.lead("least").over(groups).alias("next"),
                    F.coalesce(F.sum("dv").over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base")))
    both = swept.join(sums, ["mk", "restart", "group"]).select(
        "mk", "restart", (F.col("v") + F.col("base")).alias("value"), F.col("delta").alias("a"), F.coalesce("after", "next").alias("b"))
    both = both.where(F.col("b").isNull() | (F.col("b") - F.col("a") > MIN_STRETCH))
    far = lambda c: 1e-3 * F.greatest(F.lit(1.0), F.abs(c))  # noqa: E731  what an open end leaves beside its event
    open_left, margin = F.col("a") == float("-inf"), F.least((F.col("b") - F.col("a")) * 0.1, F.lit(1e6))
    low = F.when(open_left, F.lit(float("-inf"))).otherwise(F.col("a") + F.when(F.col("b").isNull(), far(F.col("a"))).otherwise(margin))
    high = F.when(F.col("b").isNull(), F.lit(float("inf"))).otherwise(F.col("b") - F.when(open_left, far(F.col("b"))).otherwise(margin))
    return both.select("mk", "restart", F.least(F.greatest(F.lit(0.0), low), high).alias("delta"), "value")


class Line:
    """What the objective needs of each (model, restart) along its coordinate:
    mean NDCG less ``reg`` times the distance from the start, on weights whose
    absolute values sum to 1."""

    def __init__(self, w: np.ndarray, start: np.ndarray, f: np.ndarray, lists: np.ndarray, reg: float):
        here = np.arange(len(w))
        self.wf, self.sf, self.lists, self.reg = w[here, f], start[here, f], lists, reg
        self.l1, self.ww, self.ws, self.ss = np.abs(w).sum(1), (w * w).sum(1), (w * start).sum(1), (start * start).sum(1)

    def objective(self, m: np.ndarray, delta: np.ndarray, value: np.ndarray) -> np.ndarray:
        """At ``delta`` of the models ``m``; minus infinity where no weight is left."""
        wf, sf = self.wf[m], self.sf[m]
        new = wf + delta
        size = self.l1[m] - np.abs(wf) + np.abs(new)
        left = np.where(size > 1e-12, size, 1.0)
        apart = ((self.ww[m] - wf * wf + new * new) / (left * left)
                 - 2 * (self.ws[m] - wf * sf + new * sf) / left + self.ss[m])
        return np.where(size > 1e-12, value / self.lists[m] - self.reg * np.sqrt(np.maximum(apart, 0.0)), -np.inf)


def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A place between ``a`` and ``b`` (either may be infinite), as near to 0 as
    the inner four fifths allow; an open end leaves a thousandth beside its event."""
    far = lambda c: 1e-3 * np.maximum(1.0, np.abs(c))
    open_left, open_right = a == -np.inf, b == np.inf
    with np.errstate(invalid="ignore"):
        margin = np.minimum((b - a) * 0.1, 1e6)
        low = np.where(open_left, -np.inf, a + np.where(open_right, far(a), margin))
        high = np.where(open_right, np.inf, b - np.where(open_left, far(b), margin))
    return np.maximum(np.minimum(np.maximum(0.0, low), high), -np.finfo(float).max)


def _by_model_and_place(m: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Order by model, then by place (and so by bin of places). The models are
    few: dealt first, each one's places are sorted alone."""
    order = np.argsort(m.astype(np.int16) if len(m) and m.max() < 1 << 15 else m, kind="stable")
    ends = np.flatnonzero(np.diff(m[order])) + 1
    return np.concatenate([own[np.argsort(delta[own])] for own in np.split(order, ends)])


def _swept(m: np.ndarray, delta: np.ndarray, dv: np.ndarray, line: Line, fine: int) -> tuple:
    """Of whole bins of events: (model, bin, delta, value without the bins
    before) of the places that can be its best whatever those add. The stretch
    behind a bin's last event is not among them."""
    order = _by_model_and_place(m, delta)
    m, delta, dv = m[order], delta[order], dv[order]
    group = _bin_of(delta, fine)
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (group[1:] != group[:-1])]))
    size = np.diff(np.append(new, len(m)))
    value, end = np.empty(len(m)), new + size - 1
    for s, e in zip(new.tolist(), (end + 1).tolist()):
        value[s:e] = np.cumsum(dv[s:e])
    inner = np.ones(len(m), bool)
    inner[end] = False
    inner = np.flatnonzero(inner)
    inner = inner[delta[inner + 1] - delta[inner] > MIN_STRETCH]
    m, group, value, at = m[inner], group[inner], value[inner], _place(delta[inner], delta[inner + 1])
    o = line.objective(m, at, value)
    number = np.repeat(np.arange(len(new)), size)[inner]
    best = np.full(len(new), -np.inf)
    np.maximum.at(best, number, o)
    near = np.flatnonzero((o >= best[number] - 2e-10) & (o > -np.inf))
    # of near equals, those that no other excels in value at a smaller or equal distance
    near = near[np.lexsort((-at[near], np.abs(at[near]), number[near]))]
    kept, last, most = [], -1, -np.inf
    for i, g, v in zip(near.tolist(), number[near].tolist(), o[near].tolist()):
        if g != last or v > most:
            kept.append(i)
            last, most = g, v
    return m[kept], group[kept], at[kept], value[kept]


#: cells (model, bin of the line) of a coordinate that a task sums, at most
CELLS = 1 << 16


def _bin_of(delta: np.ndarray, fine: int) -> np.ndarray:
    """Number of the bin of the line a place lies in, rising from 0: ``_group_of`` in ``fine`` parts."""
    size = np.arcsinh(np.clip(delta, -1e300, 1e300) * 1000) * 3 * fine
    return (np.clip(np.round(size), -64 * fine, 64 * fine) + 64 * fine).astype(int)


def _cells_that_matter(net, rise, least, last, line: Line) -> tuple:
    """Of the sums of each (model, bin): the value before each bin, the places
    between two bins (model, delta, value), and which bins can hold a better
    place than the best of those: at most the bin's rises are added to the value
    before it, and the start is no nearer than the bin's width allows."""
    models, bins = net.shape
    base = np.cumsum(net, 1) - net
    m, cell = np.nonzero(least <= last)
    ends = np.append(m[1:] != m[:-1], True)
    after = np.where(ends, np.inf, np.append(least[m, cell][1:], np.inf))
    gap = after - last[m, cell] > MIN_STRETCH
    between = m[gap], _place(last[m, cell], after)[gap], (base + net)[m, cell][gap]
    found = np.full(models, -np.inf)
    np.maximum.at(found, between[0], line.objective(*between))
    low, high = least[m, cell], last[m, cell]
    with np.errstate(invalid="ignore"):
        wide = high - low
        # along the line the normalised weights move by no more than 2 / the least size of the weights there
        rest, wf = line.l1[m] - np.abs(line.wf[m]), line.wf[m]
        thin = rest + np.where((wf + low <= 0) & (wf + high >= 0), 0.0, np.minimum(np.abs(wf + low), np.abs(wf + high)))
        top = (base + rise)[m, cell]
        far = top / line.lists[m] - line.objective(m, np.where(np.isfinite(low), low, 0.0), top)
        far = np.where(np.isfinite(low) & np.isfinite(far) & (thin > 1e-12), far - line.reg * 2 * wide / np.maximum(thin, 1e-12), 0.0)
        bound = top / line.lists[m] - np.maximum(far, 0.0)
    open_ = (high > low) & (bound >= found[m] - 1e-9)
    matter = np.zeros(net.shape, bool)
    matter[m[open_], cell[open_]] = True
    return base, between, matter


def best_places(packed: RDD, n_parts: int, models: dict[str, np.ndarray], w: np.ndarray, f: np.ndarray, line: Line,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(model, objective, delta) of the best stretch of each model that has one.
    ``models`` are the rows of ``w`` for each mk. Tasks first sum their events
    in bins of the line; only events of bins that can hold the best place are
    then dealt out and swept."""
    fine = int(np.clip(CELLS // (129 * len(w)), 1, 64))
    bins = 128 * fine + 1

    def events(blocks: Iterator[tuple]) -> tuple:
        out = [(own[row], delta, dv) for block in blocks if (own := models.get(block[0])) is not None
               for row, delta, dv in [_block_events(block, w[own], f[own], k)]]
        m, delta, dv = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0))
        return m, delta, dv, m * bins + _bin_of(delta, fine)

    def summed(blocks: Iterator[tuple]) -> Iterator[tuple]:
        _, delta, dv, cell = events(blocks)
        least, last = np.full(len(w) * bins, np.inf), np.full(len(w) * bins, -np.inf)
        np.minimum.at(least, cell, delta)
        np.maximum.at(last, cell, delta)
        yield (np.bincount(cell, dv, len(w) * bins), np.bincount(cell, np.maximum(dv, 0.0), len(w) * bins), least, last)

    def both(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])

    sums = packed.mapPartitions(summed)
    sums = sums.treeReduce(both) if packed.getNumPartitions() > 32 else sums.reduce(both)
    base, between, matter = _cells_that_matter(*(x.reshape(len(w), bins) for x in sums), line)
    of_cell = matter.ravel()

    def dealt(blocks: Iterator[tuple]) -> Iterator[tuple]:
        m, delta, dv, cell = events(blocks)
        own = np.flatnonzero(of_cell[cell])
        m, delta, dv, cell = m[own], delta[own], dv[own], cell[own]
        to = cell % n_parts
        order = np.argsort(to.astype(np.int16) if n_parts < 1 << 15 else to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(n_parts + 1))
        for p, (s, e) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if e > s:
                yield p, (m[order[s:e]], delta[order[s:e]], dv[order[s:e]])

    def swept(parts: Iterator[tuple]) -> Iterator[tuple]:
        found = [x for _, x in parts]
        if found:
            yield _swept(*(np.concatenate(x) for x in zip(*found)), line, fine)

    found = packed.mapPartitions(dealt).partitionBy(n_parts, lambda p: p).mapPartitions(swept).collect() if of_cell.any() else []
    inner = [(m, at, value + base[m, cell]) for m, cell, at, value in found]
    m, at, value = (np.concatenate(x) for x in zip(between, *inner))
    o = np.round(line.objective(m, at, value), 10)
    order = np.lexsort((-at, np.abs(at), -o, m))
    m, o, at = m[order], o[order], at[order]
    best = np.concatenate([np.ones(len(m[:1]), bool), m[1:] != m[:-1]]) & (o > -np.inf)
    return m[best], o[best], at[best]


def start_state(lists: DataFrame, n_features: int, restarts: int, seed: int = SEED) -> DataFrame:
    """A row per model and restart: weights, start weights, order of the
    coordinates and objective. Restart 0 starts from equal weights in the order
    of the features; the others' weights and orders are seeded hashes."""
    models = lists.groupBy("mk").agg(F.count("*").alias("lists"))
    rows = models.select("mk", "lists", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    features = F.sequence(F.lit(0), F.lit(n_features - 1))
    unit = lambda i, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("mk"), F.col("restart"), i), F.lit(1 << 32)) / float(1 << 32)
    drawn = F.transform(features, lambda i: unit(i, "w") * 2 - 1)
    rows = rows.withColumn("drawn", F.when(F.col("restart") == 0, F.array_repeat(F.lit(1.0), n_features)).otherwise(drawn))
    l1 = F.aggregate("drawn", F.lit(0.0), lambda s, x: s + F.abs(x))
    order = F.transform(F.array_sort(F.transform(features, lambda i: F.struct(unit(i, "o").alias("u"), i.alias("i")))), lambda e: e["i"])
    rows = rows.withColumn("w", F.transform("drawn", lambda x: x / l1))
    return rows.select("mk", "restart", "lists", "w", F.col("w").alias("start"), F.when(F.col("restart") == 0, features).otherwise(order).alias("order"),
                       F.lit(float("-inf")).alias("objective"), F.lit(float("-inf")).alias("before"), F.lit(True).alias("live"))


def coordinate_ascent(zwide: DataFrame, keys: list[str], n_features: int, restarts: int = 16, reg: float = 0.1,
                      k: int = CUTOFF, seed: int = SEED, tolerance: float = 0.001) -> DataFrame:
    """Train one linear model per key value and restart.

    ``zwide``: (…keys, query_id, doc_id, relevance, s0…) already z-scored. The
    objective is the mean NDCG@k less ``reg`` times the distance from the start
    weights. A sweep takes every coordinate in the model's order and moves it to
    the best stretch of its line; a model is done when a sweep gains no more
    than ``tolerance``, so there are at most ``1 / tolerance`` sweeps.
    Lists without a relevant document count as 0. Returns (…keys, restart, idx,
    w, objective)."""
    key_expr = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    lists = query_lists(zwide, keys, n_features, k).withColumn("mk", key_expr)
    lists = lists.select("mk", *keys, "query_id", "docs", "idcg").checkpoint(eager=True)
    rows = start_state(lists, n_features, restarts, seed).orderBy("mk", "restart").collect()
    names = lists.select("mk", *keys).distinct()
    w, start = np.array([r.w for r in rows], float).reshape(len(rows), n_features), np.array([r.start for r in rows], float)
    order, counts = np.array([r.order for r in rows], int).reshape(len(rows), n_features), np.array([r.lists for r in rows], float)
    objective, live = np.full(len(rows), -np.inf), np.ones(len(rows), bool)
    n = lists.count()
    slots = lists.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, min(n // LISTS_A_TASK, slots), n // MAX_LISTS)
    packed = packed_lists(lists, n_parts).persist(StorageLevel.MEMORY_AND_DISK)
    while live.any():
        before = objective.copy()
        models: dict[str, list] = {}
        for i in np.flatnonzero(live).tolist():
            models.setdefault(rows[i].mk, []).append(i)
        models = {mk: np.array(own) for mk, own in models.items()}
        for pos in range(n_features):
            f = order[:, pos]
            m, o, delta = best_places(packed, n_parts, models, w, f, Line(w, start, f, counts, reg), k)
            better = o > objective[m]
            m = m[better]
            w[m, f[m]] += delta[better]
            objective[m] = o[better]
            w /= np.abs(w).sum(1, keepdims=True)
        live &= objective > before + tolerance
    packed.unpersist()
    ends = [(r.mk, r.restart, x.tolist(), float(o)) for r, x, o in zip(rows, w, objective)]
    state = lists.sparkSession.createDataFrame(ends, "mk string, restart int, w array<double>, objective double")
    return (state.join(names, "mk").select(*keys, "restart", F.posexplode("w").alias("idx", "w"), "objective"))
