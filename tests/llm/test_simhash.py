import numpy as np
import xxhash

from ranklane.llm import simhash
from ranklane.llm.graph import connected_components


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def clustered(seed=3, centres=40, near=12, flips=3):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(near):
            f = c
            for b in rng.choice(64, flips, replace=False).tolist():
                f ^= 1 << b
            out.append(f)
    return list(dict.fromkeys(out))


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_fingerprint_is_the_majority_of_hashes():
    for text in ["", None, "One", "a b c d", "A b c d e f g a b c d", "é ü x y z\x0bq r s t"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_span_brute_force_components(spark):
    fps = clustered()
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = plain_components(fps, 4)
    for bucket in (simhash.MAX_BUCKET, 3):
        links = simhash.fingerprint_links(df, len(fps), 4, bucket)
        got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        label = [got.get(signed(f), signed(f)) for f in fps]
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_every_block_scheme_keeps_each_linked_pair():
    rng = np.random.default_rng(0)
    for n in (10, 10 ** 6, 10 ** 10):
        masks = simhash.block_masks(simhash._blocks_for(n, 4), 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = {}
    for r in simhash.near_duplicates(odd).collect():
        rows.setdefault(r.doc_id, []).append(r.component_id)
    assert rows[1] == rows[2] == rows[3] == [1] and rows[5] == [4] and rows[8] == [0]
    assert rows[7] == [7, 7] and rows[None] == [None] and rows[9] == [9]
    assert simhash.near_duplicates(empty).count() == 0


def test_null_ids_take_part(spark):
    df = spark.createDataFrame([(None, "alike"), (None, "alike"), (5, "alike"), (None, "other")], "doc_id long, text string")
    assert sorted((r.component_id or -1) for r in simhash.near_duplicates(df).collect()) == [-1, 5, 5, 5]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
