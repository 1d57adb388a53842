import random
import re

from pyspark.sql import functions as F

from ranklane.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(400)]


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain(docs, items, least=5):
    """Every diagonal of every pair, compared in full."""
    out = set()
    for i, t in docs:
        d = toks(t)
        for k, u in items:
            b = toks(u)
            if len(b) < least:
                continue
            w = min(len(b), 20)
            for off in range(-len(b), len(d)):
                same = [0 <= off + j < len(d) and d[off + j] == b[j] for j in range(len(b))]
                if any(sum(same[s:s + w]) >= 0.8 * w for s in range(len(b) - w + 1)):
                    out.add((i, k))
    return out


def planted(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([3, 6, 8, 12, 25, 40])))) for k in range(12)]
    docs = []
    for i in range(60):
        body = rng.choices(WORDS, k=rng.randint(0, 80))
        if i % 3 == 0:
            passage = toks(rng.choice(items)[1])
            if len(passage) >= 20 and i % 2:  # every sixth token replaced
                passage = [f"x{j}" if j % 6 == 5 else p for j, p in enumerate(passage)]
            at = rng.randint(0, len(body))
            body[at:at] = [passage[0].upper() + ",", *passage[1:]]
        docs.append((i, "  ".join(body)))
    return docs, items


def test_planted_passages_and_no_others(spark):
    docs, items = planted()
    want = plain(docs, items)
    assert len(want) > 12
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (dc.BROADCAST_SEEDS, 0):
        got = {(r.doc_id, r.item_id) for r in dc.passages(d, b, broadcast_seeds=limit).collect()}
        assert got == want


def test_no_python_in_the_plan(spark, odd):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog by the river bank")], "item_id long, text string")
    plan = dc.contaminated(odd, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog by the river"), (2, None), (3, ""),
                                   (4, "word5 word6 word7 word8 word9 word10"), (4, "word5 word6 word7 word8 word9 word10"),
                                   (None, "a lone row")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {r.doc_id: (r.n_items, r.item_ids) for r in dc.contaminated(odd, items).collect()}
    assert got == {0: (1, "1"), 8: (1, "1"), 4: (1, "4"), 5: (1, "4")}
    assert dc.contaminated(empty, items).count() == 0 and dc.contaminated(odd, items.limit(0)).count() == 0


def test_a_very_long_item_and_both_joins(spark):
    rng = random.Random(3)
    long = rng.choices([f"v{i}" for i in range(5_000)], k=50_000)
    docs = [(0, " ".join(rng.choices(WORDS, k=500))), (1, " ".join(long[:25])), (2, " ".join(long[-20:])), (3, " ".join(long[-15:])), (6, " ".join(long[-16:]))]
    docs += [(4, " ".join(w if j % 6 else "x" for j, w in enumerate(long[30_000:30_300]))), (5, " ".join(long))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[100:130]))], "item_id long, text string")
    want = {(1, 1, 20), (2, 1, 20), (4, 1, 17), (5, 1, 20), (5, 2, 20), (6, 1, 16)}
    for limit in (10 ** 6, 0):
        assert {(r.doc_id, r.item_id, r.matched) for r in dc.passages(d, b, broadcast_seeds=limit).collect()} == want


def test_the_oracle_and_items_of_any_length(spark):
    import duckdb
    docs, items = planted(5)
    items += [(20, "w1"), (21, "w7 w8"), (22, "zz yy xx ww")]
    docs += [(90, "a w7 w8 b"), (91, "zz yy xx ww"), (92, "zz yy xx"), (93, "")]
    want = plain(docs, items, 1)
    assert {(90, 21), (91, 22)} <= want and (92, 22) not in want
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.passages(d, b, min_item=1).collect()} == want
    documents, benchmark = d.toPandas(), b.toPandas()  # noqa: F841 - read by name
    rows = duckdb.sql(dc.ORACLE).fetchall()
    got = [tuple(r) for r in dc.contaminated(d, b, min_item=1).select("doc_id", "n_items", "item_ids", "overlap").collect()]
    assert sorted(rows) == sorted(got)
