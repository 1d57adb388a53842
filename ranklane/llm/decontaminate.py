"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are lower-cased and cut to tokens of letters and digits. A mask is a
pattern of positions of which some are ignored; its seed at a position is the
hash of the tokens at the others. Seeds of all documents and all benchmark
items are joined, so a passage is found although tokens were replaced, as long
as one mask somewhere ignores the replaced ones. Each hit gives a diagonal: the
document's tokens laid beside the item's. There, a window of ``window`` tokens
(the whole item, if it is shorter) with at least ``overlap`` of its tokens
equal, place by place, is a verified passage. The masks miss none at the default
window and overlap; a larger window or a lower overlap may need more of them.

The seeds of a document are made where its tokens are, in the scan's stage, and
only hits leave it. A seed of the benchmark carries the tokens around it that a
window holding it can reach, under three windows of them however long the item
is, so ``BROADCAST_SEEDS`` bounds the bytes of a broadcast. Beyond that many
seeds both sides are shuffled by seed and salt without any tokens, and tokens
are fetched for the hits' diagonals, with the same result.

Defined cases: a null text counts as empty; items of fewer than ``min_item``
tokens are not looked for (they are common speech; with ``min_item=1`` every
item with a token is); items of fewer than ``SHORT`` tokens have masks that
ignore one position each, those of under five tokens are found whole; repeated
ids are one document; passages in rows with a null id are reported under a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# every mask begins and ends with a 1. Of the ways to replace a fifth of 9 to 20
# tokens none escapes all of them (tests/llm/test_masks.py tries each)
MASKS = ("110101011", "101101101", "111000111", "111111", "1111011", "1101111", "11101101")
#: items of fewer tokens have masks of their own size
SHORT = 9
WINDOW = 20
OVERLAP = 0.8
MIN_ITEM = 5
#: seeds of a broadcast, each of under 3 * WINDOW tokens: about 64 MB
BROADCAST_SEEDS = 131_072
#: parts of a seed that very many documents share
SALTS = 16
_NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text; an empty array if it has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_TOKEN, " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def short_masks(n: int) -> list[str]:
    """Masks that ignore one of ``n`` positions each: a run of ``n`` - 1 tokens
    (an end is ignored) and the inner positions. Under five tokens one place is
    more than a fifth, so none is ignored."""
    if n < 5:
        return ["1" * n]
    return ["1" * (n - 1), *("1" * k + "0" + "1" * (n - 1 - k) for k in range(1, n - 1))]


def _seeds(df: DataFrame, toks: str, at: str, masks: list[str]) -> DataFrame:
    """A row per position and mask: ``at``, ``mask`` and the ``seed``. One
    seed expression serves all masks (their places come from a literal table):
    its code stays small enough for the JIT, so an array of tokens is read
    where it is and not copied into every row."""
    care = [[k for k, c in enumerate(mask) if c == "1"] for mask in masks]
    width = max(map(len, care))
    places = F.lit([k for c in care for k in c + c[-1:] * (width - len(c))])
    span = F.lit([len(mask) for mask in masks])
    least, n = min(map(len, masks)), len(masks)
    rows = (df.where(F.size(toks) >= least)
            .withColumn("_p", F.explode(F.sequence(F.lit(0), (F.size(toks) - least + 1) * n - 1)))
            .withColumn("mask", F.col("_p") % n).withColumn(at, F.expr(f"int(_p div {n})")).drop("_p")
            .where(F.col(at) + F.get(span, F.col("mask")) <= F.size(toks)))
    return rows.withColumn("seed", F.xxhash64("mask", *[
        F.get(F.col(toks), F.col(at) + F.get(places, F.col("mask") * width + k)) for k in range(width)]))


def passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, overlap: float = OVERLAP,
             min_item: int = MIN_ITEM, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, matched, compared): each document and item with a
    verified passage, and the equal tokens of its best window."""
    bench = (items.select(F.col(f"`{item_id}`").alias("item_id"), tokens(F.col(f"`{item_text}`")).alias("b"))
             .where(F.size("b") >= max(min_item, 1)).distinct())
    sizes = bench.where(F.size("b") < SHORT).select(F.size("b").alias("n")).distinct()
    short = sorted(r.n for r in sizes.collect())  # fewer than SHORT values
    own = [(mask, n) for n in short for mask in short_masks(n)]
    masks = [*MASKS, *(mask for mask, _ in own)]
    # a mask for a short length is for items of that length
    sized = F.get(F.lit([0] * len(MASKS) + [n for _, n in own]), F.col("mask"))
    # windows that hold a seed at j reach from ``window`` - 1 tokens before it to
    # ``window`` after; j is rounded down to a block, so that the seeds of one
    # block lay the same part of the item beside a document
    block = F.col("j") - F.col("j") % window
    low = F.greatest(block - (window - 1), F.lit(0))
    wide = F.least(F.size("b"), block + (2 * window - 1)) - low
    compared = F.least(F.size("b"), F.lit(window))
    bench = bench.withColumn("item", F.xxhash64("item_id", "b"))
    bench_seeds = _seeds(bench, "b", "j", masks).where((F.col("mask") < len(MASKS)) | (F.size("b") == sized))
    few = bench_seeds.count() <= broadcast_seeds
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), tokens(F.col(f"`{text_col}`")).alias("d"))
    if few:
        beside = bench_seeds.select("seed", "item_id", compared.alias("compared"), F.slice("b", low + 1, wide).alias("part"),
                                    (F.col("j") - low).alias("at"))
        hits = (_seeds(rows, "d", "i", masks).select("doc_id", "d", "i", "seed").join(F.broadcast(beside), "seed")
                .withColumn("start", F.col("i") - F.col("at")))
    else:
        # the keys are made once a row, below the step that makes its seeds
        rows = rows.withColumn("row", F.xxhash64("doc_id", "d"))
        thin = _seeds(rows, "d", "i", masks).select("seed", F.pmod(F.xxhash64("row", "i"), F.lit(SALTS)).cast("int").alias("salt"), "row", "i")
        dealt = bench_seeds.select("seed", "item", "j", F.explode(F.lit(list(range(SALTS)))).alias("salt"))
        found = (thin.join(dealt, ["seed", "salt"])
                 .select("row", "item", block.alias("j"), (F.col("i") - F.col("j")).alias("off")).distinct())
        parts = (bench.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("b") - 1, F.lit(window))))
                 .select("item", "j", "item_id", compared.alias("compared"), low.alias("low"), F.slice("b", low + 1, wide).alias("part")))
        hits = (found.join(parts, ["item", "j"]).join(rows, "row")
                .withColumn("start", F.col("off") + F.col("low")))
    # the document's tokens beside the part's, from its token ``skip`` on (a
    # slice is made in generated code: no hit copies a whole document)
    first = F.greatest(F.col("start"), F.lit(0))
    skip = first - F.col("start")
    # once per diagonal; that the verdict reads an aggregate (shift) keeps it
    # above this step, out of the join's condition
    laid = (hits.select("doc_id", "item_id", "compared", "part", skip.alias("skip"),
                        F.slice("d", first + 1, F.size("part") - skip).alias("beside"))
            .groupBy("doc_id", "item_id", "compared", "part", "skip", "beside").agg(F.max("skip").alias("shift")))
    same = F.transform(F.sequence(F.lit(0), F.size("part") - 1), lambda k: F.coalesce(
        (F.get(F.col("beside"), k - F.col("shift")) == F.get(F.col("part"), k)).cast("int"), F.lit(0)))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1),
        lambda s: F.size(F.filter(F.slice(F.col("same"), s, F.col("compared")), lambda x: x == 1))))
    return (laid.select("doc_id", "item_id", "compared", same.alias("same"))
            .select("doc_id", "item_id", "compared", best.alias("matched"))
            .where(F.col("matched") >= F.col("compared") * overlap)
            .groupBy("doc_id", "item_id")
            .agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared")))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_items, item_ids, overlap): one row per document that holds a
    passage of the benchmark."""
    found = passages(docs, items, **options)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",").alias("item_ids"),
        F.max(F.col("matched") / F.col("compared")).alias("overlap"))


#: the same in DuckDB SQL, with token strings instead of hashes; items of fewer
#: than nine tokens are laid on every place
ORACLE = """
WITH toks AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS d FROM documents),
bench AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS b FROM benchmark),
masks(mask, span, care) AS (VALUES
  {MASK_ROWS}),
longer AS (SELECT * FROM bench WHERE len(b) >= 9),
item_at AS (SELECT item_id, b, unnest(range(0, len(b))) AS j FROM longer),
item_seeds AS (
  SELECT mask, item_id, j, array_to_string(list_transform(care, lambda k: b[j + k + 1]), ' ') AS seed
  FROM item_at, masks WHERE j + span <= len(b)),
doc_at AS (SELECT doc_id, d, unnest(range(0, len(d))) AS i FROM toks),
doc_seeds AS (
  SELECT mask, doc_id, i, array_to_string(list_transform(care, lambda k: d[i + k + 1]), ' ') AS seed
  FROM doc_at, masks WHERE i + span <= len(d)),
short AS (SELECT * FROM bench WHERE len(b) BETWEEN 1 AND 8),
diagonals AS (
  SELECT DISTINCT doc_id, item_id, i - j AS off FROM doc_seeds JOIN item_seeds USING (mask, seed)
  UNION SELECT doc_id, item_id, unnest(range(-1, len(d))) FROM toks, short),
laid AS (
  SELECT doc_id, item_id, off, least(len(b), 20) AS compared,
         list_transform(range(0, len(b)), lambda k: CASE WHEN off + k >= 0 AND off + k < len(d) AND d[off + k + 1] = b[k + 1] THEN 1 ELSE 0 END) AS same
  FROM diagonals JOIN toks USING (doc_id) JOIN bench USING (item_id)),
best AS (
  SELECT doc_id, item_id, compared,
         list_max(list_transform(range(1, len(same) - compared + 2), lambda s: list_sum(same[s:s + compared - 1]))) AS matched
  FROM laid),
found AS (
  SELECT doc_id, item_id, max(matched) AS matched, max(compared) AS compared FROM best
  WHERE matched >= 0.8 * compared GROUP BY doc_id, item_id)
SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids,
       max(CAST(matched AS DOUBLE) / compared) AS overlap
FROM found GROUP BY doc_id
""".replace("{MASK_ROWS}", ",\n  ".join(
    f"({n}, {len(mask)}, {[k for k, c in enumerate(mask) if c == '1']})" for n, mask in enumerate(MASKS)))
