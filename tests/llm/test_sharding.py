import zlib

import numpy as np

from ranklane.llm import sharding as sh


def test_differencing_two_parts_by_hand():
    # 8 7 6 5 4 in two parts: the differences are 8-7=1, 6-5=1, 4-1=3, 3-1=2
    sizes = np.array([8, 7, 6, 5, 4])
    tuples = np.zeros((5, 2), np.int64)
    tuples[:, 0] = sizes
    part = sh.difference(tuples)[:, 0]
    assert abs(sizes[part == 0].sum() - sizes[part == 1].sum()) == 2


def test_differencing_keeps_parts_apart():
    rng = np.random.default_rng(1)
    tuples = rng.integers(0, 1000, (30, 5))
    final = sh.difference(tuples)
    assert (np.sort(final, axis=1) == np.arange(5)).all()
    sums = np.bincount(final.ravel(), tuples.ravel())
    assert np.ptp(sums) < np.ptp(tuples.sum(axis=0))


def check(rows, shards=40):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for members in by.values():
        assert sorted(m.slot for m in members) == list(range(len(members)))
    where = {}
    for r in rows:
        assert where.setdefault(r.digest, r.shard) == r.shard and 0 <= r.shard < shards
    return [sum(m.size for m in by.get(s, [])) for s in range(shards)]


def test_balance_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for block, spread in ((sh.BLOCK, 0.01), (600, 0.25)):  # one block, and a few bundles of two
        rows = sh.balanced_shards(docs, block=block).collect()
        assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
            i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
        sums = check(rows)
        assert max(sums) - min(sums) < spread * np.mean(sums)


def test_several_levels_and_a_hot_group(spark):
    sizes = {i: (i * 7919) % 1000 + 1 for i in range(3000)} | {9999: 300_000}
    groups = spark.createDataFrame(list(sizes.items()), "item long, bytes long")
    got = {r.item: r.shard for r in sh.partition_groups(groups, 4, block=1000, bundles=250).collect()}
    sums = np.bincount(list(got.values()), [sizes[i] for i in got], 4)
    assert got.keys() == sizes.keys() and np.ptp(sums) < 0.01 * sums.mean()


def test_odd_rows(odd, empty):
    rows = sh.balanced_shards(odd).collect()
    check(rows)
    assert len(rows) == odd.count() and sh.balanced_shards(empty).count() == 0
