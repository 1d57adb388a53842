import numpy as np
from pyspark.sql import functions as F

from ranklane.llm import langid
from ranklane.llm.common import held_out


def test_known_words_then_longest_known_grams():
    one, two = np.array([-1.0, -2.0]), np.array([-3.0, -1.0])
    m = langid.Model(["a", "b"], {"tree": 0}, {"^tr": 0, "ou": 1, "t": 1}, np.array([one, two]))
    assert (langid.word_scores(m, "tree") == one).all()
    assert (langid.word_scores(m, "trou") == one).all()  # a three-gram beats two- and one-grams
    assert (langid.word_scores(m, "xout") == two).all()
    assert langid.word_scores(m, "zzz") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blind = docs.withColumn("lang", F.when(~held_out(F.col("doc_id")), F.col("lang")))
    assert langid.identify(docs).exceptAll(langid.identify(blind)).count() == 0


def test_odd_rows(odd, empty):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0)
    assert got[4][0] in ("de", "en", "es", "fr") and 0 <= got[4][1] <= 1
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rows_of_known_language_are_kept_whole(odd, empty):
    model = langid.fit(odd)
    found = {r.doc_id: r for r in langid.identify(odd).collect()}
    want = sorted((r for r in odd.collect() if r.doc_id is None or found[r.doc_id].score >= 0.5), key=str)
    assert sorted(langid.keep_known(odd, model, 0.5).collect(), key=str) == want
    assert langid.keep_known(empty, model, 0.5).count() == 0


def test_large_ids_beside_null_ones(spark):
    df = spark.createDataFrame([((1 << 60) + 1, "a b"), (None, "c d")], "doc_id long, text string")
    assert {r.doc_id for r in langid.identify(df.withColumn("lang", F.lit("en"))).collect()} == {(1 << 60) + 1, None}
