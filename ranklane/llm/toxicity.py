"""Toxicity by gradient-boosted trees over dense features, with isotonic
calibration.

Features: densities of a fixed and of a learned lexicon (words, and word
stems), how near second-person words stand to lexicon hits, and the rates of
capitals, punctuation and obfuscated spellings. The learned lexicon holds the
words (and stems) that toxic documents use more often than others.

Fitting reads at most about ``max_rows`` labelled documents that are not held
out, chosen by a fixed hash of the id, in two halves. The lexicon of one half
gives the features of the other, and trees fitted on one half give scores of
the other: all the isotonic curve sees is out-of-fold. A document's score is the
curve at the mean of both halves' trees, with the lexicon of both.

Defined cases: null or empty texts have all-zero features and are scored like
any other; without at least ``MIN_CLASS`` documents of either class in each
half, every score is the share of toxic labels (0 without labels); a null label
is no label; documents with a null id are scored, not learned from; a label
given twice for an id counts once, as toxic if any is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import held_out, id_and_text, null_ids, written

MAX_ROWS = 16_000
MAX_LEXICON = 400
MIN_CLASS = 4
THRESHOLD = 0.7
STEM = 5
CACHE = 150_000
NEAR = 5  # words between a second-person word and a hit

INSULTS = frozenset("""
    arse arsehole ass asshole bastard bitch bullshit clown coward creep cretin crap cunt damn dickhead dirtbag
    disgusting dumb dumbass dunce fool freak fuck garbage hate hideous idiot idiotic imbecile jerk kill lame loser
    lunatic maggot moron moronic pathetic pervert pig piss prick psycho rat retard scum scumbag shit shut sick slut
    stupid suck swine trash twat ugly useless vermin vile whore worthless wretch
    abruti connard con débile idiota imbécil estúpido basura asqueroso inútil tonto mierda gilipollas
    idiote imbécile stupide ordure pourriture dégoûtant merde salaud minable nul
    dumm dummkopf idioten blöd abschaum arschloch ekelhaft müll versager wertlos trottel
""".split())
SECOND_PERSON = frozenset("""
    you your yours yourself yourselves u ur youre you're tu te toi vous votre vos ton ta tes
    du dich dir dein deine ihr euch euer sie ihnen usted ustedes tú ti vosotros tus vuestro
""".split())
_LEET = str.maketrans("@013457$!", "aoieastsi")
_WORD = re.compile(r"[^\W_]+(?:['’@$*!][^\W_]+)*")
_OBFUSCATED = re.compile(r"[^\W\d_][@$*!0-9.\-_]+[^\W\d_]")
_LONG = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = re.compile(r"[!?.,;:]")

FEATURES = ("log_words", "insults", "any_insult", "lexicon", "lexicon_most", "lexicon_hits", "stems", "stems_most",
            "near_second_person", "second_person", "capitals", "capital_words", "punctuation", "exclamations",
            "obfuscated", "long_letters")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def words_of(chunk: str) -> list[str]:
    return _WORD.findall(chunk.lower())


class Extractor:
    """Dense features of texts, remembering those of the chunks (white-space
    separated strings) seen last."""

    WIDTH = 10

    def __init__(self, lexicon: Lexicon, cache: int = CACHE):
        self.lexicon, self.cache = lexicon, cache
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.table = np.zeros((4096, self.WIDTH))

    def _add(self, chunk: str) -> int:
        row = self.row_of[chunk] = len(self.row_of)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        out = self.table[row]
        for w in words_of(chunk):
            out[0] += 1
            plain = w.translate(_LEET).replace("*", "")
            out[1] += w in INSULTS or plain in INSULTS
            weight = max(self.lexicon.words.get(w, 0.0), self.lexicon.words.get(plain, 0.0))
            out[2] += weight
            out[3] += weight > 0
            out[4] += self.lexicon.stems.get(w[:STEM], 0.0)
            out[5] += w in SECOND_PERSON
        out[6] = len(chunk) > 1 and chunk.isupper()
        out[7] = len(_PUNCTUATION.findall(chunk))
        out[8] = _OBFUSCATED.search(chunk) is not None
        out[9] = _LONG.search(chunk) is not None
        return row

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        chunks = (text or "").split()
        if not chunks:
            return out
        if len(self.row_of) > self.cache:
            self.forget()
        get, parts = self.row_of.get, []
        for at in range(0, len(chunks), 1 << 16):
            part = chunks[at:at + (1 << 16)]
            rows = [get(c) for c in part]
            if None in rows:
                rows = [self._add(c) if (r := get(c)) is None else r for c in part]
            parts.append(np.array(rows))
        rows = np.concatenate(parts)
        seen = self.table[rows]
        total = seen.sum(axis=0)
        n = max(total[0], 1.0)
        hits, second = np.flatnonzero((seen[:, 1] > 0) | (seen[:, 3] > 0)), np.flatnonzero(seen[:, 5] > 0)
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        capitals = int(((raw >= 65) & (raw <= 90)).sum())
        out[:] = (math.log1p(total[0]), total[1] / n, total[1], total[2] / n, seen[:, 2].max(), total[3], total[4] / n,
                  seen[:, 4].max(), near, total[5] / n, capitals / len(raw), total[6] / n, total[7] / n,
                  int((raw == 33).sum()) / len(raw), total[8] / n, total[9] / n)
        return out


def features(docs: DataFrame, lexicons: dict[int, Lexicon], half_col: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and more) without the text and with ``features``;
    ``half_col`` says by which lexicon (one of a fixed, bounded size)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {k: Extractor(x) for k, x in shared.value.items()}
        for rows in batches:
            keys = rows[half_col].tolist() if half_col else [0] * len(rows)
            out = rows[kept].copy()
            out["features"] = [made[k](t).tolist() for k, t in zip(keys, rows["text"])]
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInPandas(run, f"{schema}, features array<double>")


def learn_lexicons(learned: DataFrame) -> dict[int, Lexicon]:
    """Lexicons of half 0, of half 1, and (2) of both, from the documents'
    distinct words and stems."""
    # as words_of(), in SQL: the words of a document, each once
    words = F.expr(r"array_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+(?:[\'’@$*!][\\p{L}\\p{N}]+)*)', 1))")
    rows = learned.select("half", "toxic", words.alias("w"))
    terms = rows.select("half", "toxic", F.explode(F.concat(
        F.transform("w", lambda w: F.concat(F.lit("w"), w)),
        F.array_distinct(F.transform("w", lambda w: F.concat(F.lit("s"), F.substring(w, 1, STEM)))))).alias("term"))
    sums = lambda h, t: F.sum(((F.col("half") == h) & (F.col("toxic") == t)).cast("int")).alias(f"n{h}{t}")
    four = [sums(h, t) for h in (0, 1) for t in (0, 1)]
    sizes = rows.agg(*four).first()
    if sizes["n00"] is None:
        return {0: Lexicon(), 1: Lexicon(), 2: Lexicon()}
    counted = written(terms.groupBy("term").agg(*four).where("n01 + n11 > 2"), "toxic-terms")

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        bad, good = ("+".join(f"n{h}{t}" for h in halves) for t in (1, 0))
        total_bad, total_good = (sum(sizes[f"n{h}{t}"] for h in halves) for t in (1, 0))
        odds = F.expr(f"ln((({bad}) + 0.5) / {total_bad + 1}) - ln((({good}) + 0.5) / {total_good + 1})")
        out = Lexicon()
        for kind, into in (("w", out.words), ("s", out.stems)):
            found = (counted.where(F.col("term").startswith(kind)).where(f"({bad}) > 2").select("term", odds.alias("odds"), F.expr(bad).alias("n"))
                     .where("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("n")), "term").limit(MAX_LEXICON))
            into.update({r.term[1:]: r.odds for r in found.collect()})
        return out

    return {0: lexicon((0,)), 1: lexicon((1,)), 2: lexicon((0, 1))}


@dataclass
class Model:
    lexicon: Lexicon
    trees: list[GBTClassificationModel]
    curve: object
    constant: float | None = None


def _margin(rows: DataFrame, trees: GBTClassificationModel, name: str) -> DataFrame:
    """Adds the trees' margin for the toxic class."""
    out = trees.transform(rows)
    return out.withColumn(name, F.element_at(vector_to_array("rawPrediction"), 2)).drop("rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, rounds: int = 15, depth: int = 4) -> Model:
    marks = (labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    count = marks.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 32)) / float(1 << 32)
    chosen = marks.where(spread < min(1.0, max_rows / max(count, 1)))
    rows = id_and_text(docs, id_col, text_col).join(chosen, "doc_id")
    learned = written(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")), "toxic-learned")
    lexicons = learn_lexicons(learned)
    # the other half's lexicon gives the features
    made = features(learned.withColumn("by", 1 - F.col("half")), {0: lexicons[0], 1: lexicons[1]}, "by")
    made = written(made.repartition(8).withColumn("label", F.col("toxic").cast("double")), "toxic-features")
    made = made.withColumn("features", array_to_vector("features"))
    sizes = {(r.half, r.toxic): r.n for r in made.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if any(sizes.get((h, t), 0) < MIN_CLASS for h in (0, 1) for t in (0, 1)):
        return Model(lexicons[2], [], None, sum(n for (_, t), n in sizes.items() if t) / total if total else 0.0)
    trees = [GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=2).fit(made.where(f"half = {h}"))
             for h in (0, 1)]
    apart = _margin(made.where("half = 1"), trees[0], "margin").union(_margin(made.where("half = 0"), trees[1], "margin"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(apart)
    return Model(lexicons[2], trees, curve)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    if model.constant is not None:
        scored = rows.withColumn("score", F.lit(float(model.constant)))
    else:
        made = features(rows, {0: model.lexicon}).withColumn("features", array_to_vector("features"))
        for n, trees in enumerate(model.trees):
            made = _margin(made, trees, f"m{n}")
        scored = model.curve.transform(made.withColumn("margin", (F.col("m0") + F.col("m1")) / 2))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return null_ids(scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted")))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on the labelled part of ``docs`` and scores all of it."""
    return predict(docs, fit(docs, labels, **options))
