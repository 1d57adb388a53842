"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A word's adjacent pairs are the leaves of a tree whose nodes hold the smallest
(rank, place) below them, so the root is the leftmost pair of lowest rank. A
merge replaces that pair and updates the leaves beside it up to the root, and
words are done when the root holds no rank. Words of like length have their
trees side by side in one array and merge together; a long word has a tree of
its own.

The vocabulary file's path is a parameter; ids and decoded text are those of
the tokenizers library for the same file. Texts are cut at white space, which
no token of this vocabulary holds, and what is in between is encoded once per
task and remembered in a cache of bounded size.

Defined cases: a null text counts as empty and has no ids; a special token's
string in a text is that token; texts that decode from no ids are empty;
repeated rows and null ids are encoded like any other.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ranklane.llm.common import id_and_text, null_ids

#: chunks (white-space separated strings) remembered by a task
CACHE = 200_000
#: pair leaves above which a word has its own tree
WIDE = 64
_NONE = np.iinfo(np.int64).max
_PLACE = 32  # bits of a leaf's place in a node


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Merge ranks and results by pair of ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocab.values(), default=0) + 1
        self.of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            # a later line for the same pair replaces the earlier, as in the library
            self.of[vocab[a], vocab[b]] = (rank, vocab[a + b])
        keys = np.array([a * self.size + b for a, b in self.of], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.ranks = np.append(np.array([r for r, _ in self.of.values()], np.int64)[order], -1)
        self.result = np.zeros(len(pairs) + 1, np.int64)
        for rank, made in self.of.values():
            self.result[rank] = made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it does not merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_word(symbols: list[int], merges: Merges) -> list[int]:
    """Ids of one word by its own segment tree."""
    n = len(symbols) - 1
    if n < 1:
        return list(symbols)
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    ids, of, none = list(symbols), merges.of, (1 << 62, 0)
    after, before = [*range(1, n + 2)], [*range(-1, n)]
    tree = [none] * (2 * width)
    for i in range(n):
        if (found := of.get((ids[i], ids[i + 1]))) is not None:
            tree[width + i] = (found[0], i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, value: tuple[int, int]) -> None:
        node = width + leaf
        tree[node] = value
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    def pair(i: int) -> tuple[int, int]:
        j = after[i]
        found = of.get((ids[i], ids[j])) if j <= n else None
        return none if found is None else (found[0], i)

    while tree[1] is not none and tree[1] != none:
        _, i = tree[1]
        j = after[i]
        ids[i] = of[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = after[j]
        if after[j] <= n:
            before[after[j]] = i
        if j < n:
            put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [x for x in ids if x >= 0]


def encode_words(words: list[list[int]], merges: Merges) -> list[list[int]]:
    """Ids of many words, whose trees of equal width merge side by side."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum()))
    return [np.frombuffer(ids, "<u4").tolist() for ids in encode_flat(flat, sizes, merges)]


def encode_flat(flat: np.ndarray, sizes: np.ndarray, merges: Merges) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each word; the words' symbols lie
    one after the other in ``flat``."""
    starts = np.cumsum(sizes) - sizes
    out = [b""] * len(sizes)
    for n in np.flatnonzero(sizes == 1).tolist():
        out[n] = int(flat[starts[n]]).to_bytes(4, "little")
    for n in np.flatnonzero(sizes > WIDE + 1).tolist():
        out[n] = np.array(encode_word(flat[starts[n]:starts[n] + sizes[n]].tolist(), merges), "<u4").tobytes()
    width = 1
    while width <= WIDE:
        members = np.flatnonzero((sizes - 1 <= width) & (sizes - 1 > width // 2))
        for at in range(0, len(members), 1 << 15):
            part = members[at:at + (1 << 15)]
            for n, ids in zip(part.tolist(), _side_by_side(flat, starts[part], sizes[part], width, merges)):
                out[n] = ids
        width *= 2
    return out


def _side_by_side(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, merges: Merges) -> list[bytes]:
    rows = len(sizes)
    ids = np.full((rows, width + 2), -1, np.int64)
    inside = np.arange(width + 2) < sizes[:, None]
    ids[inside] = flat[(starts[:, None] + np.arange(width + 2))[inside]]
    after = np.tile(np.arange(1, width + 3), (rows, 1))
    before = np.tile(np.arange(-1, width + 1), (rows, 1))
    tree = np.full((rows, 2 * width), _NONE)
    rank = merges.rank(ids[:, :width], ids[:, 1:width + 1])
    leaf = (rank >= 0) & (np.arange(width) < sizes[:, None] - 1)
    tree[:, width:][leaf] = (rank << _PLACE | np.arange(width))[leaf]
    step = width >> 1
    while step:
        tree[:, step:2 * step] = np.minimum(tree[:, 2 * step:4 * step:2], tree[:, 2 * step + 1:4 * step:2])
        step >>= 1

    def put(r, place, value):
        node = place + width
        tree[r, node] = value
        while width > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            if node[0] == 1:
                break

    def pair(r, i):
        j = after[r, i]
        found = merges.rank(ids[r, i], ids[r, np.minimum(j, width + 1)])
        found[j >= sizes[r]] = -1
        return np.where(found >= 0, found << _PLACE | i, _NONE)

    live = np.arange(rows)
    while True:
        root = tree[live, 1]
        live = live[root != _NONE]
        if not len(live):
            break
        root = root[root != _NONE]
        i = root & ((1 << _PLACE) - 1)
        j = after[live, i]
        ids[live, i] = merges.result[root >> _PLACE]
        ids[live, j] = -1
        nxt = after[live, j]
        after[live, i] = nxt
        inner = nxt < sizes[live]
        before[live[inner], nxt[inner]] = i[inner]
        gone = j < width
        if gone.any():
            put(live[gone], j[gone], _NONE)
        put(live, i, pair(live, i))
        left = before[live, i]
        has = left >= 0
        if has.any():
            put(live[has], left[has], pair(live[has], left[has]))
    kept = ids >= 0
    packed = ids[kept].astype("<u4").tobytes()
    ends = [0, *(4 * np.cumsum(kept.sum(axis=1))).tolist()]
    return [packed[a:b] for a, b in zip(ends, ends[1:])]


class Recent(dict):
    """A cache of bounded size: when it is full, what was not asked for since it
    was last full is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def knows(self, key) -> bool:
        return key in self or key in self.older

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class WordCodec:
    """Encodes and decodes like the library does with a vocabulary of words:
    lower-cased, white space dropped, word ends marked, byte symbols inside."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if (steps, split["type"], level["type"], spec["decoder"], spec["post_processor"]) != (
                ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None, None):
            raise ValueError(f"{path} is not a vocabulary of lower-case words")
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.path, self._library = path, None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
        self.token = {i: t for t, i in {**vocab, **added}.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.chunk, self.word = Recent(cache), Recent(cache)  # their ids as bytes

    @property
    def library(self) -> Tokenizer:
        """Read only for the few chunks that need the library's own normaliser."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _normal(self, chunk: str) -> str:
        # the library folds case character by character; Python differs for
        # a capital sigma at a word's end
        if chunk.isascii() or "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk):
            return chunk.lower()
        return self.library.normalizer.normalize_str(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks not seen before."""
        whole, cut = {}, {}
        for c in chunks:
            if c in self.special:
                self.chunk[c] = self.special[c]
                continue
            low = self._normal(c)
            if low.isalpha():
                whole[c] = low
            else:
                cut[c] = self.pieces.findall(low)
        word = self.word
        words = [w for w in {*whole.values(), *chain.from_iterable(cut.values())} if not word.knows(w)]
        if words:
            data = [w.encode("utf-8", "surrogatepass") for w in words]
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            raw, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - 1
            flat = self.inner[raw]
            flat[ends] = self.last[raw[ends]]
            word.update(zip(words, encode_flat(flat, sizes, self.merges)))
        self.chunk.update((c, word[low]) for c, low in whole.items())
        self.chunk.update((c, b"".join(map(word.__getitem__, found))) for c, found in cut.items())

    def _chunks(self, text: str) -> list[str]:
        # str.split() also cuts at 0x1C-0x1F, which are no white space to the library
        return text.split() if not _SEPARATORS.search(text) else [c for c in _SPACE.split(text) if c]

    def _parts(self, text: str) -> list[str]:
        """Chunks and special tokens of a text."""
        if not any(s in text for s in self.special):
            return self._chunks(text)
        return list(chain.from_iterable([x] if x in self.special else self._chunks(x) for x in self.cut.split(text)))

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """(ids, decoded text) of every text."""
        self.chunk.turn()
        self.word.turn()
        parts = [self._parts(t or "") for t in texts]
        new = [c for c in set(chain.from_iterable(parts)) if not self.chunk.knows(c)]
        if new:
            self.learn(new)
        ids = [np.frombuffer(b"".join(map(self.chunk.__getitem__, p)), "<u4") for p in parts]
        return [(i, self.decode(i.tolist())) for i in ids]

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a
        decoder of its own, the vocabulary's tokens are joined by a blank."""
        return " ".join(map(self.token.__getitem__, ids))


_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           with_output: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for,
    ``ids`` (little-endian unsigned 32-bit) and ``decoded``, for every row."""
    more = "ids binary, decoded string, " if with_output else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordCodec(path)  # the task's own: a reused worker keeps nothing of it
        for rows in batches:
            for at in range(0, len(rows), 512):
                part = rows.iloc[at:at + 512]
                found = words.encode_batch(part["text"].tolist())
                out = {"doc_id": part["doc_id"].to_numpy()}
                if with_output:
                    out |= {"ids": [i.tobytes() for i, _ in found], "decoded": [t for _, t in found]}
                yield pd.DataFrame(out | {
                    "n_tokens": [len(i) for i, _ in found],
                    "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i, _ in found],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in found]})

    return null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, f"doc_id long, {more}n_tokens long, ids_sha256 string, decoded_sha256 string"))
