import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ranklane.llm import warc


def plain(rows):
    first = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        ref = first.get(b)
        ref = ref if ref is not None and ref != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def some_pages(n=120):
    rng = random.Random(4)
    bodies = ["".join(rng.choices("abcdef <>é\r\n", k=rng.choice([0, 30, 99, 100, 101, 500, 9000]))) for _ in range(40)]
    rows = [(i * 13 % 997, f"http://h/{i}\r\nX: y" if i % 5 else None, rng.choice(bodies)) for i in range(n)]
    return rows + [(None, "u", "z" * 200), (None, "u", "z" * 200), (2000, "u", "z" * 200), (None, "v", "q" * 300),
                   (None, "v", "q" * 300), (2001, "u", None), (2002, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 50),
                   (2003, "a", "same" * 50), (2003, "a", "same" * 50)]


@pytest.mark.parametrize("size", [37, 1000, 1 << 24])
def test_every_record_is_read_once_whatever_the_ranges(spark, size):
    rows = some_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, archive=20_000).cache()
    got = sorted(map(tuple, warc.read_archives(manifest, size).collect()), key=str)
    assert got == plain(rows)


def test_false_magic_and_foreign_members(tmp_path):
    one, two = warc.record(1, "http://a/", b"p" * 500, None), warc.record(2, None, b"", None)
    junk = b"\x1f\x8b\x08" + bytes(range(256)) + gzip.compress(b"no record here") + b"\x1f\x8b"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(one + junk + two + one[:100])  # the last member is cut short
    whole = [warc.parsed(c)[0] for c in warc.records_of(str(path), 0, path.stat().st_size)]
    assert whole == [1, 2]
    size = path.stat().st_size
    parts = [warc.parsed(c)[0] for s in range(0, size, 50) for c in warc.records_of(str(path), s, min(size, s + 50), 64)]
    assert parts == whole
    assert gzip.decompress(one + two).count(b"WARC/1.1\r\n") == 2


def test_odd_rows(odd, empty):
    kw = {"id_col": "doc_id", "url_col": "source", "html_col": "text"}
    assert warc.read_archives(warc.write_archives(odd, **kw)).count() == odd.count()
    assert warc.read_archives(warc.write_archives(empty, **kw)).count() == 0


def test_ranges_are_read_by_many_tasks(spark):
    rows = [(i, "u", f"{i} " + "".join(random.Random(i).choices("abcdefgh", k=2000))) for i in range(60)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    size = manifest.agg(F.sum("n_bytes")).first()[0] // 20
    read = warc.read_archives(manifest, size)
    assert read.select(F.spark_partition_id()).distinct().count() >= 10
    assert sorted(r.page_id for r in read.collect()) == list(range(60))
