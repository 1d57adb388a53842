"""Language identification by known words, backing off to character n-grams.

A word seen in training scores its log frequency in each language. An unseen
word falls back to its longest character n-grams that are known, first of
five characters, then four, down to one. A document's score is the posterior
over the languages of all its words.

Fitting reads at most about ``rows_per_lang`` labelled documents a language
(a fixed hash of the id chooses them), and keeps at most ``max_words`` words and
``max_grams`` n-grams: each language's most frequent up to an equal share, then
the most frequent of all. The model has a fixed largest size and is broadcast. Prediction reads every whole text.

Defined cases: ``und`` with score 0 for a null text or one without a letter;
no labelled document gives ``und`` everywhere; a word with no known n-gram
counts for no language; equal scores go to the first language by name;
documents with a null id are predicted, not learned from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import held_out, id_and_text, null_ids

ROWS_PER_LANG = 1500
MAX_WORDS = 60_000
MAX_GRAMS = 120_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
UNKNOWN = "und"
CACHE = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Log frequencies by language: rows of ``table``, by word and by n-gram."""
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def word_scores(model: Model, word: str) -> np.ndarray | None:
    """Log frequency by language of a word or, unseen, of the longest of its
    n-grams that are known (their mean); None if none is."""
    if (row := model.words.get(word)) is not None:
        return model.table[row]
    padded = f"^{word}$"
    for n in ORDERS:
        known = [g for i in range(len(padded) - n + 1) if (g := model.grams.get(padded[i:i + n])) is not None]
        if known:
            return model.table[known].mean(axis=0)
    return None


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = ROWS_PER_LANG, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """The model of the labelled documents that are not held out."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang"))
    learned = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    model = Model(langs)
    if not langs:
        return model
    # a hash below the language's share of 2^32 chooses the rows
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n))])
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 32)) / float(1 << 32)
    chosen = learned.where(spread < share[F.col("lang")])
    words = chosen.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)")).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    word_table = (counted.groupBy("word").agg(by_lang.alias("n"), F.sum("n").alias("total"))
                  .where("total > 1"))
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = counted.withColumn("p", padded).select(
        "lang", "n", F.explode(F.flatten(F.array(*[
            F.when(F.length("p") >= n, F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("p") - n + 1, F.lit(1))),
                lambda i, n=n: F.substring(F.col("p"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
            for n in ORDERS]))).alias("gram"))
    gram_table = (grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("gram")
                  .agg(by_lang.alias("n"), F.sum("n").alias("total"))
                  .where("total > 2"))

    def kept(table: DataFrame, key: str, most: int) -> tuple[list[str], np.ndarray]:
        """Each language's most frequent rows, up to its share of ``most``;
        what shares leave is filled by total: the keys and their counts by
        language. The tasks find the rows, which reach the driver as Arrow
        batches: no list of a task and no object a row is held there."""
        listed = F.array(*[F.coalesce(F.col("n")[x], F.lit(0)) for x in langs])
        table, found, counts = table.persist(), {}, np.zeros((most, len(langs)), np.int64)

        def take(rows: DataFrame) -> None:
            for batch in rows.select(key, listed.alias("counts")).toArrow().to_batches():
                own = batch.column("counts").flatten().to_numpy().reshape(-1, len(langs))
                for k, row in zip(batch.column(key).to_pylist(), own):
                    if len(found) < most and k not in found:
                        counts[len(found)] = row
                        found[k] = len(found)

        for x in langs:
            n = F.col("n")[x]
            take(table.where(n.isNotNull()).orderBy(n.desc(), key).limit(most // len(langs)))
        take(table.orderBy(F.desc("total"), key).limit(most))
        table.unpersist()
        return list(found), counts[:len(found)]

    def scored(counts: np.ndarray, orders: list[int]) -> np.ndarray:
        """Log frequency of every row among those of its order."""
        out, orders = np.zeros(counts.shape), np.array(orders, int)
        for o in np.unique(orders):
            own = orders == o
            rate = (counts[own] + SMOOTH) / (counts[own].sum(axis=0) + SMOOTH * own.sum())
            out[own] = np.reshape([math.log(r) for r in rate.ravel().tolist()], rate.shape)
        return out

    words, word_counts = kept(word_table, "word", max_words)
    grams, gram_counts = kept(gram_table, "gram", max_grams)
    model.words = {w: i for i, w in enumerate(words)}
    model.grams = {g: len(words) + i for i, g in enumerate(grams)}
    model.table = np.concatenate([scored(word_counts, [0] * len(words)), scored(gram_counts, [len(g) for g in grams])])
    return model


class Scorer:
    """Scores texts, remembering the scores of the chunks (words with their
    punctuation) of the texts seen last."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.cache = model, cache
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.model.langs)))

    def _add(self, chunk: str) -> int:
        row = self.row_of[chunk] = len(self.row_of)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        scores = [s for w in _LETTERS.findall(chunk) if (s := word_scores(self.model, w)) is not None]
        if scores:
            self.table[row] = sum(scores)
        return row

    def __call__(self, text: str | None) -> tuple[str, float]:
        model = self.model
        if not text or not model.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.row_of) > self.cache:
            self.forget()
        total, get = np.zeros(len(model.langs)), self.row_of.get
        chunks = text.lower().split()
        for at in range(0, len(chunks), 1 << 16):
            part = chunks[at:at + (1 << 16)]
            rows = [get(c) for c in part]
            if None in rows:
                rows = [self._add(c) if (r := get(c)) is None else r for c in part]
            total += self.table[rows].sum(axis=0)
        best = int(total.argmax())
        return model.langs[best], float(1 / np.exp(total - total[best]).sum())



def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for rows in batches:
            found = [score(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "held_out": rows["held_out"],
                                "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    rows = id_and_text(docs, id_col, text_col)
    return null_ids(rows.withColumn("held_out", held_out(F.col("doc_id")))
                    .mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double"))


def keep_known(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose language is predicted with a score
    of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for rows in batches:
            kept = [x != UNKNOWN and s >= min_score for x, s in map(score, rows.column(text_at).to_pylist())]
            yield rows.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled part of ``docs`` and predicts all of it."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
