"""Every pattern of replaced tokens that the verification accepts is found."""

from itertools import combinations

from ranklane.llm import decontaminate as dc

from .test_decontaminate import plain


def patterns(sizes):
    """An item of each size and a document for every way to replace a fifth of it."""
    items, docs, want = [], [], set()
    for n in sizes:
        words = [f"i{n}t{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for away in combinations(range(n), n - -(-n * 8 // 10)):
            doc = len(docs)
            docs.append((doc, " ".join(f"x{k}" if k in away else w for k, w in enumerate(words))))
            assert plain(docs[-1:], items[-1:]) == {(doc, n)}
            want.add((doc, n))
    return items, docs, want


def found(spark, items, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in dc.passages(d, b).collect()}


def test_every_pattern_of_9_to_20_tokens(spark):
    items, docs, want = patterns(range(9, 21))
    assert len(docs) > 7_000 and found(spark, items, docs) == want


def test_every_pattern_of_short_items(spark):
    items, docs, want = patterns(range(5, 9))
    inside = [(100 + i, f"y1 y2 {t} z1") for i, t in docs]
    assert found(spark, items, [*docs, *inside]) == want | {(100 + i, k) for i, k in want}
    cut = [(0, "i5t1 i5t2 i5t3 i5t4"), (1, "i8t0 i8t1 i8t2 i8t3 i8t4 i8t5 i8t6"), (2, "i5t1 i5t2 i5t3")]
    assert found(spark, items, cut) == plain(cut, items) == {(0, 5), (1, 8)}
