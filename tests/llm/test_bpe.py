import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ranklane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return bpe.WordCodec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def greedy(symbols, merges):
    """The rule itself: merge the leftmost pair of lowest rank until none is left."""
    ids = list(symbols)
    while True:
        ranks = [merges.of.get(p, (1 << 60,))[0] for p in zip(ids, ids[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return ids
        i = ranks.index(min(ranks))
        ids[i:i + 2] = [merges.of[ids[i], ids[i + 1]][1]]


def test_trees_as_the_rule(words):
    rng = random.Random(2)
    cases = []
    for _ in range(600):
        b = "".join(rng.choices("abethinosrld", k=rng.choice([1, 2, 3, 5, 8, 9, 17, 40, 64, 65, 66, 130]))).encode()
        cases.append([*(words.inner[x] for x in b[:-1]), words.last[b[-1]]])
    want = [greedy(c, words.merges) for c in cases]
    assert bpe.encode_words(cases, words.merges) == want
    assert [bpe.encode_word(c, words.merges) for c in cases] == want


TEXTS = ["", " ", "Hello, World! it's 2024's BEST", "don't we'll I'm they've", "été ÉTÉ naïve Straße İstanbul",
         "été combining ́alone", "ΟΔΥΣΣΕΥΣ Σ ΑΣ.", "日本語のテキスト 한국어", "a\x1cb\x1dc d\x85e f　g​h",
         "<|startoftext|>Hi<|endoftext|> there<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>", "🙂👍🏽 ok", "tab\tnew\nline\r\n",
         "n1234567890", "''s''t", "#*$%&|<>" * 5, "a" * 5000, "ab" * 300 + "." * 300, "ﬁ ǅ ŉ ẞ", "\x00\x01 nul", "don'T 'S 'Re"]


def test_ids_and_decoding_as_the_library(words, library):
    docs = [r[0] for r in __import__("duckdb").sql(
        "select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    texts = TEXTS + docs
    want = library.encode_batch(texts, add_special_tokens=False)
    for t, w, (ids, text) in zip(texts, want, words.encode_batch(texts)):
        assert ids.tolist() == w.ids, t[:80]
        assert text == library.decode(w.ids, skip_special_tokens=False) == words.decode(ids.tolist()), t[:80]


def test_small_cache_gives_the_same(words):
    small = bpe.WordCodec(PATH, cache=3)
    for t in TEXTS:
        a, b = small.encode_batch([t])[0], words.encode_batch([t])[0]
        assert (a[0] == b[0]).all() and a[1] == b[1]


def test_odd_rows(odd, empty, library):
    for r in bpe.encode(odd, PATH).collect():
        if r.doc_id in (1, 2, 3):
            assert r.n_tokens == 0 and r.decoded == "" and r.ids_sha256 == hashlib.sha256(b"").hexdigest()
        else:
            assert library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) == r.decoded
    assert bpe.encode(empty, PATH).count() == 0
