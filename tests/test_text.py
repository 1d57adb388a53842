"""Text, URL and id functions."""

from pyspark.sql import functions as F

from ranklane.functions import text as tx


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_tokenize_words_and_punctuation(spark):
    assert one(spark, tx.tokenize("x"), "Hello, World! Ñaño 3.5") == \
        ["hello", ",", "world", "!", "ñaño", "3", ".", "5"]
    assert one(spark, tx.tokenize("x"), None) == []


def test_valid_tokens_drop_stop_words_and_punctuation(spark):
    assert one(spark, tx.valid_tokens(tx.tokenize("x")), "The cat, and the hat!") == ["cat", "hat"]


def test_sentence_count(spark):
    assert one(spark, tx.sentence_count("x"), "One. Two! Three? four") == 4
    assert one(spark, tx.sentence_count("x"), "") == 0
    assert one(spark, tx.sentence_count("x"), "3.5 is a number.") == 1


def test_shorten_counts_code_points(spark):
    assert one(spark, tx.shorten_text("x", 3), "ñaño") == "ñañ"


URLS = [
    ("https://a.example.com:8080/x/y", "a.example.com:8080", 2),
    ("http://user@www.example.org/", "user@www.example.org", 1),
    ("no-slashes", None, -2),
    ("http://example.net", "example.net", 0),
    ("https://a.b.co.uk/p", "a.b.co.uk", 1),
]


def test_url_host_and_depth(spark):
    for url, host, depth in URLS:
        assert one(spark, tx.url_host("x"), url) == host
        assert one(spark, tx.url_depth("x"), url) == depth
    assert one(spark, tx.url_host("x"), None) is None


def test_registrable_domain_longest_suffix(spark):
    sfx = ["com", "net", "org", "uk", "co.uk"]
    cases = {"a.b.co.uk": "b.co.uk", "www.example.com": "example.com", "example.net": "example.net",
             "co.uk": "co.uk", "host.unknowntld": "host.unknowntld", "x.y.z.unknowntld": "z.unknowntld"}
    for host, sld in cases.items():
        assert one(spark, tx.registrable_domain("x", sfx), host) == sld
    assert one(spark, tx.registrable_domain("x", sfx), None) is None


def test_hex_ids_sort_numerically(spark):
    ids = ["00000000000000ff", "0000000000000010", "FFFFFFFFFFFFFFFF", "0000000000000002", "00000000000000Aa"]
    df = spark.createDataFrame([(i,) for i in ids], "x string")
    got = [r["x"] for r in df.orderBy(tx.hex_key("x")).collect()]
    assert got == sorted(ids, key=lambda s: int(s, 16))


def test_char_grams_are_overlapping_and_whole(spark):
    assert one(spark, tx.char_grams("x", 3), "abcd") == [" ab", "abc", "bcd", "cd "]
    long = "é" * 5000
    assert len(one(spark, tx.char_grams("x", 3), long)) == 5000


def test_seeded_order_matches_duckdb(spark):
    import duckdb
    s = one(spark, tx.seeded_hash_order(F.col("x"), 42), "abc")
    assert s == duckdb.sql("select md5('42:abc')").fetchall()[0][0]


def test_registrable_domain_wildcards_and_exceptions(spark):
    rules = ["com", "*.ck", "!www.ck"]
    for host, want in (("a.b.c.ck", "b.c.ck"), ("c.ck", "c.ck"), ("x.www.ck", "www.ck"), ("www.ck", "www.ck"),
                       ("a.b.com", "b.com"), ("a.b.zz", "b.zz")):
        assert one(spark, tx.registrable_domain("x", rules), host) == want


def test_first_tokens_are_those_of_the_whole_text(spark):
    from ranklane.sources.tables import web_queries
    texts = ["One two, three! four five six seven eight nine ten eleven twelve", "", None, "  a\u00a0b  \u0130x", "x" * 300,
             ". , ; : ! ? - ( ) [ ] {", "\U0001d4b3 \U0001f600\n\tnine  ten"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for n in (0, 1, 3, 11):
        for r in df.select(tx.tokenize("text").alias("all"), tx.first_tokens("text", n).alias("some")).collect():
            assert r["some"] == r["all"][:n]
    # the query text does not match the pattern over the whole article
    plan = web_queries(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,11}" in plan


