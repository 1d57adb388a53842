import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ranklane.llm import lexical


def plain_terms(text):
    small = (text or "").translate({b: b + 32 for b in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k):
    """[(item, rank, doc_id, score)] straight from the formula."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t in plain_terms(text) if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def rows(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r[:2]))


def made(seed, n, words=60):
    rng = random.Random(seed)
    pick = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(pick, weights, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]
    return [(i, texts[rng.randrange(n)] if i % 7 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,slice_bytes", [(16 << 20, 4 << 20), (2000, 300)])
def test_best_documents_equal_brute_force(spark, block, slice_bytes):
    docs, items = made(1, 300), [(i, t) for i, t in made(2, 12)]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                           spark.createDataFrame(items, "item_id long, text string"), k=7, block=block, slice_bytes=slice_bytes)
    assert rows(found) == sorted(plain_search(docs, items, 7))


def test_terms_are_runs_of_letters_digits_and_other_characters():
    for text in ["", "A-b_c É9é\x00x\x7fy", "日本 ÀB c", "  a  ", "x" * 3_000_000 + " y"]:
        assert [t.decode() for part in lexical.terms_of(text) for t in part] == plain_terms(text)
    text = "word " * 500_000
    assert sum(len(p) for p in lexical.terms_of(text)) == 500_000


def test_positions_seen_by_direct_access_count():
    """Both lists hold the same documents at the top, in opposite order: what one
    list reads, the other has seen, so the best positions pass the read depth."""
    n = 400
    a = lexical.ImpactList(np.arange(n), np.arange(n, 0, -1) * 1000)
    b = lexical.ImpactList(np.arange(n), np.where(np.arange(n) < 64, np.arange(n) + 1_000_000, n - np.arange(n)))
    docs, scores, read = lexical.best_positions([(1, a), (1, b)], n, 5, 0)
    whole = a.impacts + b.impacts
    best = np.lexsort((np.arange(n), -whole))[:5]
    assert set(best) <= set(docs.tolist()) and read < n
    assert all(whole[d] == s for d, s in zip(docs, scores))


def test_reading_goes_on_while_documents_can_tie():
    """All documents tie: the smallest ids must be found wherever they stand."""
    n = 1000
    same = lexical.ImpactList(np.arange(n), np.full(n, 5))
    docs, _, _ = lexical.best_positions([(1, same)], n, 3, 0)
    assert len(docs) == n
    docs, _, _ = lexical.best_positions([(1, same)], n, 3, 6)  # known to be too low: the first round ends it
    assert len(docs) == lexical.FIRST_READ


def test_a_query_of_very_many_terms(spark):
    docs = made(3, 40, 3000)
    long = " ".join(f"w{i % 3000}" for i in range(50_000))
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame([(1, long)], "item_id long, text string"), k=5)
    assert rows(found) == plain_search(docs, [(1, long)], 5)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "quick brown FOX same word7"), (2, None), (3, ""), (None, "lone row"), (5, "..."), (5, "été"), (5, "same same"), (9, "absent")]
    asked = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, doc_id int, score int")
    found = lexical.search(odd, asked)
    want = plain_search(docs, items, 20)
    assert sorted(map(str, rows(found))) == sorted(map(str, want))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(empty, asked).count() == 0 and lexical.search(odd, asked.limit(0)).count() == 0
