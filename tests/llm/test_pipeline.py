import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ranklane.llm import queries

from .test_decontaminate import plain as plain_passages
from .test_simhash import plain_components, plain_fingerprint
from .test_suffix_dedup import plain as plain_repeats


def test_stages_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    steps, now = [], docs
    for _, stage in cp.STAGES:
        now = cp.written(stage(spark, now, sf), "pipeline-test")
        steps.append(now)
    for df in steps[:-1]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    first = texts(steps[0])
    assert first == {i: t for i, t in texts(docs).items() if re.search(r"[^\W\d_]", t or "")}
    ids = sorted(first)
    part = plain_components([plain_fingerprint(first[i]) for i in ids], 4)
    second = texts(steps[1])
    assert second == {ids[k]: first[ids[k]] for k in range(len(ids)) if part[k] == k}
    want = {i: k.decode("utf-8", "ignore") for i, _, _, k in plain_repeats(sorted(second.items()), 50)}
    third = texts(steps[2])
    assert third == want and all(r.n_chars == len(r.text) for r in steps[2].collect() if want[r.doc_id] != second[r.doc_id])
    bad = {i for i, _ in plain_passages(third.items(), items)}
    fourth = texts(steps[3])
    assert fourth == {i: t for i, t in third.items() if i not in bad}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in steps[4].collect():
        found = library.encode(fourth[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(found) and r.decoded == library.decode(found, skip_special_tokens=False)
    assert steps[4].count() == len(fourth)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    """Two rows of one id and one length: the stages' decisions are about rows."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words = [f"word{i % 89}x{i % 31}" for i in range(300)]
    shared, a = " ".join(words[:40]), " ".join(words[60:110])
    b = " ".join(w[::-1] for w in words[60:110])
    rows = [(1, shared + " one"), (2, a + " " + shared), (2, b + " " + shared), (3, item), (3, "of its own " + " ".join(words[200:260])),
            (None, item), (None, "no id at all " + " ".join(words[120:180])), (None, "12 34")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    cut = pairs(cp.repeated_strings(spark, docs, sf))
    assert (1, shared + " one") in cut and {t for i, t in cut if i == 2} == {a + " ", b + " "}
    left = pairs(cp.benchmark_passages(spark, docs, sf))
    assert left == sorted([r for r in rows if r[1] != item], key=str)
    near = pairs(cp.near_copies(spark, docs.union(docs.where("doc_id is null").limit(1)), sf))
    assert sum(t == item for _, t in near) == 1 and (3, item) in near and len(near) == len(rows) - 1
    assert (None, "12 34") not in pairs(cp.language(spark, docs.withColumn("doc_id", docs.doc_id), sf))


def test_odd_rows_pass_the_stages(spark, odd, empty):
    now = odd
    for name, stage in cp.STAGES:
        now = cp.written(stage(spark, now, "/root/testdata/sf0.001"), "pipeline-test")
    assert None in {r.doc_id for r in now.collect()}
    now = empty
    for name, stage in cp.STAGES:
        now = cp.written(stage(spark, now, "/root/testdata/sf0.001"), "pipeline-test")
    assert now.count() == 0


def test_one_query_an_operator():
    assert [sum(k.startswith(f"op{n}_") for k in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(cp.STAGES) == 5
