from ranklane.llm import langid


def test_a_small_language_keeps_its_words(spark):
    big, small = [f"b{c}" for c in "abcdefghijklmnopqrst"], ["sa", "sb", "sc"]
    rows = [(i, " ".join(big), "big") for i in range(60)] + [(i, " ".join(small), "small") for i in range(60, 72)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_words=10, max_grams=16)
    # the bound holds, and what a language leaves of its share goes to the others
    assert set(model.words) == {*small, *big[:7]}
    assert len(model.grams) == 16 and any("s" in g for g in model.grams)
    whole = langid.fit(docs)
    assert set(whole.words) == {*small, *big}


def test_the_rows_of_a_model_are_not_collected_as_objects(spark, monkeypatch):
    """``collect`` of the most frequent rows holds every task's list on the
    driver; the small collects are one row a language."""
    rows = [(i, " ".join(f"{'wv'[i % 2]}{chr(97 + i % 7 + j)}" for j in range(15)), "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: sizes.append(len(got := collect(df))) or got)
    model = langid.fit(docs)
    assert len(model.words) > 20 and len(model.table) == len(model.words) + len(model.grams)
    assert sizes and max(sizes) <= 2
