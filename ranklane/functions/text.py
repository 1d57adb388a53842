"""Column-level text, URL and id expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklane.functions.constants import STOP_WORDS, TEXT_LENGTH_LIMIT

# words (letters/digits) or a single punctuation mark
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD_PATTERN = r"^[\p{L}\p{N}]+$"
WORDS_PATTERN = r"[\p{L}\p{N}]+"
SENTENCE_SPLIT = r"[.!?]+(\s|$)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shorten_text(c, limit: int = TEXT_LENGTH_LIMIT) -> Column:
    """First ``limit`` code points."""
    return F.substring(_col(c), 1, limit)


def tokenize(c) -> Column:
    """Lower-cased tokens: words plus single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def first_tokens(c, n: int) -> Column:
    """The first ``n`` tokens; the text behind them is lower-cased, not matched.
    Whatever is no token is white space, so they are a prefix of the text."""
    prefix = rf"^(?:\s*+(?:[\p{{L}}\p{{N}}]++|[^\s\p{{L}}\p{{N}}])){{0,{n}}}+"
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.regexp_extract_all(F.regexp_extract(text, prefix, 0), F.lit(TOKEN_PATTERN), 0)


def is_valid_token(t: Column, stop_words: list[str] | None = None) -> Column:
    """Not a stop word, not punctuation, all letters/digits (P10)."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return (~t.isin(*stop)) & t.rlike(WORD_PATTERN)


def is_valid_of_tokens(t: Column, stop_words: list[str] | None = None) -> Column:
    """``is_valid_token`` for what ``tokenize`` makes: a token that begins with
    a-z is a word, so only others are tested by the pattern."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return (~t.isin(*stop)) & (((t >= "a") & (t < "{")) | t.rlike(WORD_PATTERN))


def valid_tokens(c, stop_words: list[str] | None = None) -> Column:
    """Array filter form of P10."""
    return F.filter(_col(c), lambda t: is_valid_token(t, stop_words))


def words(c, stop_words: list[str] | None = None) -> Column:
    """``valid_tokens(tokenize(c))`` in one pass: punctuation is not matched,
    so no token is tested by a pattern of its own."""
    stop = STOP_WORDS if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(WORDS_PATTERN), 0)
    return F.filter(found, lambda t: ~t.isin(*stop))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_bag(tokens: Column) -> Column:
    """Distinct terms of a token array with their counts, sorted by term:
    ``array<struct<term, tf>>``. Row-local: sorting brings equal tokens
    together, and a term's count is the distance to the next term's start."""
    def counted(s):
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))
    return let(F.sort_array(tokens), counted)


def sentence_count(c) -> Column:
    """Number of non-blank pieces between sentence ends."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), SENTENCE_SPLIT)
    return F.size(F.filter(parts, lambda x: F.length(F.trim(x)) > 0))


def url_host(c) -> Column:
    """Third '/'-separated piece of the URL, as ``url.split('/')[2]``.
    NULL when the URL has fewer pieces or is NULL."""
    return F.get(F.split(_col(c), "/"), 2)


def url_depth(c) -> Column:
    """Number of '/' minus 2 (FD10); NULL URL gives NULL."""
    u = _col(c)
    return F.length(u) - F.length(F.regexp_replace(u, "/", "")) - F.lit(2)


def hex_key(c) -> Column:
    """Numeric key of a hex id (P14), exact for up to 16 hex digits."""
    return F.conv(_col(c), 16, 10).cast("decimal(20,0)")


def hex_id(c, width: int = 16) -> Column:
    """Zero-padded lower-case hex string of an integer id."""
    return F.lpad(F.lower(F.hex(_col(c))), width, "0")


def seeded_hash_order(c, seed: int) -> Column:
    """Deterministic shuffle key, identical in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(c).cast("string")))


def seeded_bucket(c, seed: int, n: int) -> Column:
    """Deterministic bucket 0..n-1 from the first 32 bits of the md5."""
    h = F.conv(F.substring(seeded_hash_order(c, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n))


def char_grams(c, n: int = 3) -> Column:
    """All overlapping character n-grams of the whole lower-cased text,
    padded by a blank on each side. One linear regex pass (a zero-width
    lookahead capturing the next ``n`` code points at every position);
    per-position ``substring`` would rescan the string and be quadratic."""
    s = F.concat(F.lit(" "), F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(" "))
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def registrable_domain(host, suffixes: list[str]) -> Column:
    """Public suffix plus one label (P13). The suffix is the longest rule that
    matches: a plain rule, a wildcard (``*.ck``: any one label below) or, before
    all others, an exception (``!www.ck``: the suffix is what follows its first
    label). Without a match the last label is the suffix; a host that is
    itself a suffix is returned whole; NULL host → NULL. The rules are a bounded
    parameter evaluated as set membership per row, so no join is needed."""
    h = _col(host)
    plain = [r for r in suffixes if r[:1] not in "*!"]
    wild = [r[2:] for r in suffixes if r.startswith("*.")]
    exempt = [r[1:] for r in suffixes if r.startswith("!")]
    labels = F.split(h, r"\.")
    n = F.size(labels)

    def among(depth: Column, rules: list[str]) -> Column:
        return F.array_join(F.slice(labels, n - depth + 1, depth), ".").isin(*rules) if rules else F.lit(False)

    def longest(match) -> Column:
        found = F.transform(F.sequence(F.lit(1), n), lambda d: F.when(match(d), d).otherwise(F.lit(0)))
        return F.coalesce(F.array_max(found), F.lit(0))

    ps = F.greatest(longest(lambda d: among(d, plain)), F.lit(1))
    if wild:
        ps = F.greatest(ps, longest(lambda d: (d > 1) & among(F.greatest(d - 1, F.lit(1)), wild)))
    if exempt:
        spared = longest(lambda d: among(d, exempt))
        ps = F.when(spared > 0, spared - 1).otherwise(ps)
    take = F.least(ps + 1, n)
    return F.when(h.isNull(), F.lit(None).cast("string")).otherwise(
        F.array_join(F.slice(labels, n - take + 1, take), "."))
