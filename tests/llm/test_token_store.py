import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from ranklane.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(b):
    return [int.from_bytes(b[i:i + 4], "little") for i in range(0, len(b), 4)]


def test_pieces_encode_as_whole_texts(library):
    docs = [r[0] for r in __import__("duckdb").sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts = ["", " ", "  ", "a b", " a  b ", "a \n b", "a\n b\n", "end.  Two   blanks ", "é ü\xa0x　 y", "it's  the'll 12 3!",
             "<|endoftext|>", "a <|endoftext|> b", "🙂 👍🏽", "\x1c \x85 z", "tab\t x \ty", "x" * 3000] + docs
    got = ts.ByteCodec(PATH, cache=1000).encode_batch(texts)
    for t, g, w in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(g) == w.ids, t[:60]


def test_files_read_back(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    manifest = ts.write_tokens(docs, PATH, frame=4096)
    rows = {r.doc_id: r for r in ts.read_tokens(manifest).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        want = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert rows[r.doc_id].start == start and ids_of(rows[r.doc_id].ids) == want
        start += len(want)
    assert len(rows) == docs.count()


def test_wanted_documents_open_their_frames_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest = ts.write_tokens(docs, PATH, frame=4096)
    ids = [r.doc_id for r in docs.select("doc_id").limit(3).collect()]
    assert sorted(r.doc_id for r in ts.read_tokens(manifest, ids).collect()) == sorted(ids)
    file = ts.TokenFile(manifest.first()["file"])
    assert len(list(file.read([int(file.ids[0])]))) == 1 and file.frames_read == 1 < len(file.table)


def test_any_reader_decompresses_and_damage_is_seen(spark):
    manifest = ts.write_tokens(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), PATH)
    uris = [r.file for r in manifest.orderBy("part").collect()]
    whole = b""
    for uri in uris:
        with open(uri.removeprefix("file://"), "rb") as f:
            packed = f.read()
        reader = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
        whole += reader.read()
    assert whole == b"".join(bytes(r.ids) for r in ts.read_tokens(manifest).orderBy("doc_id").collect())
    path = uris[0].removeprefix("file://")
    with open(path, "rb") as f:
        packed = bytearray(f.read())
    packed[10] ^= 255
    with open(path, "wb") as f:
        f.write(packed)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(ts.TokenFile(uris[0]).read())


def test_odd_rows(odd, empty):
    rows = ts.token_digests(ts.read_tokens(ts.write_tokens(odd, PATH))).collect()
    assert len(rows) == odd.count() and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert [r.start for r in rows if r.doc_id is None] == [0]
    assert ts.read_tokens(ts.write_tokens(empty, PATH)).count() == 0


def test_files_are_read_by_many_tasks_and_pruned(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(400)], "doc_id long, text string").repartition(4)
    manifest = ts.write_tokens(docs, PATH)
    files = manifest.collect()
    read = ts.read_tokens(manifest)
    assert read.select("doc_id").distinct().count() == 400
    assert all(f.first_id <= f.last_id for f in files) and sum(f.n_docs for f in files) == 400
    if len(files) > 1:
        assert read.rdd.getNumPartitions() == len(files)
    one = ts.read_tokens(manifest, [files[0].last_id])
    assert [r.doc_id for r in one.collect()] == [files[0].last_id] and one.rdd.getNumPartitions() == 1
    assert ts.read_tokens(manifest, []).count() == 0


def test_a_full_memory_keeps_what_is_asked_for_again():
    """Strings used in every batch are never learned anew, and ids are the
    library's whatever was forgotten."""
    class Counted:
        def tokenize(self, symbols):
            learned.append(symbols)
            return model.tokenize(symbols)

    words, learned = ts.ByteCodec(PATH, cache=50), []
    model, words.model = words.model, Counted()
    texts = [" common often, " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}." for j in range(26)) for i in range(12)]
    texts += ["Élan über naïve\u00d7x ß\u01c0ŋ! I'll: it's",  " a\u0300b \u0250c, d", "trail...  two\n\n three?! ", " common often,"]
    for t in texts:
        assert words.encode_batch([t]) == [words._whole(t)]
    assert learned.count("Ġcommon") == learned.count("Ġoften") == 1
    assert max(len(words.seen), len(words.old_seen)) < 50 + 30


def test_plain_words_meet_no_pattern(monkeypatch):
    """A new string of letters and marks is encoded without a pattern, and learnt once."""
    class Refused:
        def fullmatch(self, s):
            raise AssertionError(s)

    words = ts.ByteCodec(PATH)
    monkeypatch.setattr(ts, "_WORD", Refused())
    text = "one two, three two, one?! " + " ".join(["again."] * 5)
    assert words.encode_batch([text, text]) == [words._whole(text)] * 2
    assert sorted(words.seen) == ["again.", "one?!", "three", "two,"]
