import hashlib
import random

import numpy as np

from ranklane.llm import minhash


def plain_words(text):
    return [w.lower() for w in (text or "").encode().split()]


def plain_set(text):
    words = plain_words(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_likeness(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def plain_next(rows):
    """{(id, text): next text} in order of id, nulls first, the last followed by the first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def plain_edit(text, after):
    q = len(text) // 4
    return text[:len(text) - q] + after[:q]


def made(n, seed=5):
    rng = random.Random(seed)
    words = [f"wört{i}" if i % 5 else f"W{i}\n" for i in range(400)]
    return [(3 * i, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 30, 300])))) for i in range(n)]


def test_edits_and_likeness_against_exact_sets(spark):
    rows = made(400)
    rows[10] = (30, rows[9][1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (1 << 24, 4000):
        found = {r.doc_id: r for r in minhash.edited_fingerprints(df, size=size).collect()}
        assert len(found) == 400
        for i, text, after in plain_next(rows):
            r, edit = found[i], plain_edit(text, after)
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            assert r.fingerprint == minhash.fingerprint(text) and r.edited_fingerprint == minhash.fingerprint(edit)
            # four and a half standard errors of 512 bins, and small sets' coarser ones
            assert abs(r.near_edited - plain_likeness(text, edit)) < 0.11 + 0.9 / max(3, len(plain_set(text))) * (text != edit)
            assert abs(r.near_next - plain_likeness(text, after)) < 0.06
        assert found[27].near_next == 1.0


def test_likeness_has_no_bias():
    rng = np.random.default_rng(1)
    for true, n in ((0.0, 3), (0.0, 2000), (0.3, 2000), (0.8, 500), (0.5, 60)):
        got = []
        for _ in range(120):
            both, rest = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), round(n * (1 - true) / 2)
            a = both[:n - rest] if true else both[:n]
            b = np.concatenate([both[rest:n - rest], both[n:n + rest]]) if true else both[n:]
            share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            m = minhash.likeness(minhash.bin_values(minhash._mixed(a)), minhash.bin_values(minhash._mixed(b)))
            got.append(m - share)
        assert abs(np.mean(got)) < 0.012, (true, n, np.mean(got))


def test_empty_bins_look_in_their_own_order():
    """Each empty bin takes the first filled one of its order, and orders differ."""
    order = minhash._ORDER
    assert all(sorted(row) == list(range(minhash.BINS)) for row in order[::97])
    nearest = [order[i][[3, 70, 200, 411]].argmin() for i in range(minhash.BINS)]
    assert min(np.bincount(nearest)) > minhash.BINS / 8


def test_bits_are_packed_and_unpacked():
    values = minhash.bin_values(minhash.shingle_hashes(minhash.word_hashes("a b c d e f g h")))
    assert len(minhash.packed(values)) == minhash.BINS * minhash.BITS // 8
    assert (minhash.unpacked(minhash.packed(values)) == values).all()


def test_long_texts_are_hashed_whole():
    words = [f"w{i}" for i in range(300_000)]
    assert len(minhash.word_hashes(" ".join(words))) == len(words)
    assert len(minhash.word_hashes("x" * 3_000_000)) == 1


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = minhash.edited_fingerprints(odd).collect()
    want = sorted((str(i), hashlib.sha256(plain_edit(t, n).encode()).hexdigest()) for i, t, n in plain_next(rows))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in found) == want
    assert minhash.edited_fingerprints(empty).count() == 0
    plain = {(r.doc_id, bytes(r.fingerprint)) for r in minhash.fingerprints(odd).collect()}
    assert {(r.doc_id, bytes(r.fingerprint)) for r in found} == plain
    one = minhash.edited_fingerprints(odd.where("doc_id = 0")).first()
    text = rows[0][1]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(plain_edit(text, text).encode()).hexdigest()
