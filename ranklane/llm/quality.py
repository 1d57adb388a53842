"""Quality rules in a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one failure bit a
rule with the measurements they rest on. A policy is a named, versioned mask of
rules: it is applied by one bitwise AND, so a new version reads the ledger and
no text. Ablations (what a policy would keep without one of its rules) are
sums over the bits of the same ledger.

Defined cases: a null text counts as empty, which fails ``few_words``; ratios
of an empty text are 0; null ids and repeated rows have a ledger row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import id_and_text, null_ids, written

_SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")
_SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[bytes]:
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D (all white space that
    bytes.split() knows)."""
    return text.encode("utf-8", "surrogatepass").split()


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counted = Counter(windows)
        if len(counted) < len(windows):
            reach = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if counted[w] > 1:
                    repeats += i + 3 - max(i, reach)
                    reach = i + 3
    return (n, len(text.translate(_SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
            repeats, len(lines))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame([measure(t) for t in rows["text"]], columns=MEASURES)
            found.insert(0, "doc_id", rows["doc_id"].to_numpy())
            yield found

    return null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)))


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measurements) is true. The place in
    ``RULES`` is the rule's bit for ever: new rules are added at the end."""
    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("some_repeated_words", "100 * n_repeat_words > 20 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("corpus", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words")),
    Policy("corpus", 2, ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words",
                         "some_repeated_words")),
)


def policy(name: str, version: int) -> Policy:
    for p in POLICIES:
        if (p.name, p.version) == (name, version):
            return p
    raise KeyError(f"no policy {name} version {version}")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of the rules that the
    document fails. Written once; policies and ablations read it."""
    bits = [F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return written(measurements(docs, id_col, text_col).withColumn("failed", failed), "quality-ledger")


def passes(p: Policy, failed: Column | str = "failed") -> Column:
    c = F.col(failed) if isinstance(failed, str) else failed
    return c.bitwiseAND(F.lit(p.mask)) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, version, rule, n_failed, n_alone, n_kept, n_kept_without): per
    policy and rule, the documents that fail the rule, those that fail no
    other, and what the policy keeps with and without it. One pre-aggregated
    pass: documents are counted by their bits, of which there are at most two
    to the number of rules."""
    by_bits = entries.groupBy("failed").agg(F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                                F.lit(p.mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit"))
                       for p in policies for r in p.rules])
    got = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return by_bits.select("failed", "n", F.inline(wanted)).groupBy("policy", "version", "rule").agg(
        count(got.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(got == F.col("bit")).alias("n_alone"),
        count(got == 0).alias("n_kept"), count((got == 0) | (got == F.col("bit"))).alias("n_kept_without"))


#: the ledger's base measurements and the verdict of corpus version 1, in DuckDB SQL
ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (
  SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS s
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CASE WHEN len(words) > 0 THEN CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) ELSE 0 END AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words) AS kept,
       CAST(base_failed AND n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
         + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines AS BIGINT)
         + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 15 * n_words AS BIGINT)
         + 64 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) AS failed
FROM f
"""
