import random

import pytest

from ranklane.llm import suffix_dedup as sd


def plain(rows, length):
    """(doc_id, n_removed, n_spans, kept) by a dictionary of all strings."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def mixed(seed, n, alphabet="abcdefgh ", size=300):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(alphabet, k=rng.randint(40, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices(alphabet, k=rng.randint(0, size)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts += [p[a:a + rng.randint(20, 100)], "".join(rng.choices(alphabet, k=rng.randint(0, 60)))]
        if rows and rng.random() < 0.2:
            parts = [rng.choice(rows)[1]] + parts[:rng.randint(0, 1)]
        rows.append((i * 7 % 1000, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,alphabet,block", [(1, "abcdefgh ", 2000), (2, "ab", 1 << 20), (3, "xyzé€ ", 3000)])
def test_as_brute_force(spark, monkeypatch, seed, alphabet, block):
    monkeypatch.setattr(sd.blocks_of, "__defaults__", (block,))
    rows = mixed(seed, 90, alphabet) + [(1001, ""), (1002, None), (1003, "a" * 400), (1004, "a" * 45), (1005, "a" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df).collect())
    assert got == plain(rows, 50)


def test_odd_rows(odd, empty):
    got = {}
    for r in sd.remove_repeats(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[5][0].n_removed == got[5][0].n_bytes and got[5][0].n_spans == 1 and got[4][0].n_removed == 0
    assert len(got[7]) == 2 and got[1][0].n_bytes == 0 and got[None][0].kept == b"a lone row"
    assert sd.remove_repeats(empty).count() == 0


def test_loser_tree_merges_runs_with_their_shared_prefixes():
    rng = random.Random(5)
    for k in (1, 2, 3, 7):
        runs = [sorted({bytes(rng.choices(b"ab", k=6)) for _ in range(rng.randint(0, 30))}) for _ in range(k)]
        coded = []
        for run in runs:
            shared, tails, last = [], b"", b""
            for x in run:
                h = next((i for i in range(6) if last[i:i + 1] != x[i:i + 1]), 6) if last else 0
                shared.append(h)
                tails, last = tails + x[h:], x
            coded.append((shared, tails))
        source, common, keys = sd.merged(coded, 6)
        assert keys == sorted(x for run in runs for x in run)
        for a, b, h in zip(keys, keys[1:], common[1:]):
            assert h == next((i for i in range(6) if a[i] != b[i]), 6)
        assert all([x for s, x in zip(source, keys) if s == i] == run for i, run in enumerate(runs))
