"""Token files: independent zstandard frames with a trailing seek table.

A file is frames of the token ids of whole documents (little-endian unsigned
32-bit), each with zstandard's own content checksum; a skippable frame with the
documents' ids and counts; and the seek table of the zstandard seekable format
(sizes and a checksum of each frame), which is found from the file's end. Any
zstandard reader can decompress a file as a whole; ``TokenFile`` reads the
table and decompresses only the frames of the documents asked for.

Documents are in ascending id order in and across files. Each task names its
files anew, and a file counts once its manifest row is committed, so a task
that runs again leaves nothing that is read.

Defined cases: a null text counts as empty and has the end id alone; null ids
come first; rows that share an id each have their ids in the file; an empty
table gives no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.bpe import byte_symbols
from ranklane.llm.common import id_and_text, null_ids, reading_tasks, written
from ranklane.llm.files import open_read, open_write
from ranklane.session import scratch_path

#: bytes of ids in a frame, about (a longer document is one frame)
FRAME = 1 << 20
#: strings, and pieces, in each of a codec's two ages of memory
CACHE = 300_000
END_ID = 0
_SKIP_DOCS, _SKIP_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


# The piece pattern of the byte-level vocabulary (fixed value)
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_BLANK = re.compile(r" \s|\s ")
_BLANK = re.compile(r"(?<=\S)(?= \S)")
# a word after a blank, and marks behind it: the piece pattern's own two pieces
_WORD = re.compile("( [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
_MARKS = ".,;:!?"
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(32)]
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python alone


class _Seen(dict):
    """Ids by string; a string that is not there is learnt as it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, s: str) -> bytes:
        ids = self[s] = self.learn(s)
        return ids


class ByteCodec:
    """Encodes with the tokenizers library, piece by piece: no token of a
    byte-level vocabulary joins two pieces, and no piece reaches across a blank
    between two words. So the strings from one such blank to the next, and the
    pieces in them, are given to the library's model once and remembered, as
    the bytes of their ids. A full memory becomes the old one, and what is
    asked for again comes back from there: it forgets what was not used lately."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        self.cache = cache
        self.forget()

    def forget(self) -> None:
        self.seen, self.old_seen = _Seen(self._learn), {}
        self.piece: dict[str, bytes] = {}
        self.old_piece: dict[str, bytes] = {}

    def _strings(self, text: str) -> list[str] | None:
        """The strings of a text, without the blank that all but the first
        begin with; None for a text that the library takes whole."""
        if any(s in text for s in self.special) or _SEPARATORS.search(text):
            return None
        if _ODD_BLANK.search(text):
            first, *rest = _BLANK.split(text)
            return [first, *[r[1:] for r in rest]]
        return text.split(" ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, p: str) -> bytes:
        """The ids of a piece that is not in the memory, from the old one or the model."""
        if (ids := self.old_piece.get(p)) is None:
            if p.isascii() and p[1:].isalpha():  # a letter stands for itself
                symbols = self.symbols[ord(p[0])] + p[1:]
            else:
                symbols = p.encode("utf-8").decode("latin-1").translate(self.symbols)
            found = [t.id for t in self.model.tokenize(symbols)]
            ids = _PACKED[len(found)](*found) if len(found) < len(_PACKED) else struct.pack(f"<{len(found)}I", *found)
        self.piece[p] = ids
        return ids

    def _pieces(self, s: str) -> bytes:
        known, ids_of = self.piece.get, self._ids
        return b"".join([known(p) or ids_of(p) for p in _PIECE.findall(s)])

    def _learn(self, r: str) -> bytes:
        """The ids of a blank and ``r``, a string that is not in the memory."""
        if (ids := self.old_seen.get(r)) is not None:
            return ids
        word = r.rstrip(_MARKS)
        if word.isascii() and word.isalpha():
            p, marks = " " + word, r[len(word):]
        elif (m := _WORD.fullmatch(" " + r)) is not None:
            p, marks = m.groups()
        else:
            return self._pieces(" " + r)
        known = self.piece.get
        ids = known(p) or self._ids(p)
        return ids + (known(marks) or self._ids(marks)) if marks else ids

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if len(self.seen) > self.cache:
            self.seen, self.old_seen = _Seen(self._learn), self.seen
        if len(self.piece) > self.cache:
            self.piece, self.old_piece = {}, self.piece
        ids_of, out = self.seen.__getitem__, []
        for t in texts:
            found = self._strings(t or "")
            if found is None:
                out.append(self._whole(t))
            else:
                found[0] = self._pieces(found[0])
                found[1:] = map(ids_of, found[1:])
                out.append(b"".join(found))
        return out


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


class TokenFileWriter:
    def __init__(self, uri: str, frame: int = FRAME):
        self.out, self.frame = open_write(uri), frame
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.ids, self.counts, self.table, self.held, self.size, self.n_tokens = [], [], [], [], 0, 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame:
            self._flush()
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        self.n_tokens += len(ids) // 4

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        docs = self.packer.compress(np.array([self.ids, self.counts], "<i8").tobytes())
        self.out.write(struct.pack("<II", _SKIP_DOCS, len(docs)) + docs)
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, _SEEK_MAGIC)
        # the reader finds the index of documents from its length, before the table
        self.out.write(struct.pack("<II", _SKIP_DOCS, 4) + struct.pack("<I", len(docs)))
        self.out.write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)
        self.out.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = end - 9 - 12 * n
        self.table = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        size = struct.unpack("<I", self._at(table - 12, 4))[0]
        index = zstandard.decompress(self._at(table - 20 - size, size))
        self.ids, self.counts = np.frombuffer(index, "<i8").reshape(2, -1)
        self.packed = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(self.table[:, 1])]) // 4
        self.starts = np.cumsum(self.counts) - self.counts
        self.frames_read = 0

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, n: int) -> np.ndarray:
        raw = zstandard.decompress(self._at(int(self.packed[n]), int(self.table[n, 0])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[n, 2]:
            raise ValueError(f"frame {n} does not match its checksum")
        self.frames_read += 1
        return np.frombuffer(raw, "<u4")

    def read(self, wanted=None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of the wanted documents (all by
        default), in the file's order."""
        rows = np.arange(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)))
        # the end id makes every document at least one id long, so a start names one frame
        frames = np.searchsorted(self.raw, self.starts[rows], "right") - 1
        for n in np.unique(frames).tolist():
            ids = self.frame(n)
            for r in rows[frames == n].tolist():
                at = int(self.starts[r] - self.raw[n])
                yield int(self.ids[r]), int(self.starts[r]), ids[at:at + int(self.counts[r])]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME,
                 end_id: int = END_ID) -> DataFrame:
    """Encodes and writes every row; the manifest: (part, file, n_docs,
    n_tokens, first_id, last_id, start), ``start`` being the ids in all files before."""
    folder = scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, out, uri, part = codec(path), None, None, TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)  # a worker keeps the vocabulary and what it remembers between tasks
        for rows in batches:
            ids = rows["doc_id"].tolist()
            for at in range(0, len(rows), 512):
                for doc_id, found in zip(ids[at:at + 512], words.encode_batch(rows["text"].iloc[at:at + 512].tolist())):
                    if out is None:
                        uri = f"{folder}/part-{part:07d}-{uuid.uuid4().hex}.tokens.zst"
                        out = TokenFileWriter(uri, frame)
                    out.add(doc_id, found + end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [part], "file": [uri], "n_docs": [len(out.ids)], "n_tokens": [out.n_tokens],
                                "first_id": [out.ids[0]], "last_id": [out.ids[-1]]})

    made = written(id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
                   .mapInPandas(run, "part int, file string, n_docs long, n_tokens long, first_id long, last_id long"), "token-manifest")
    # one row a file: a running sum over the list of files
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of the wanted documents, or of all; files whose
    ids do not reach a wanted one stay closed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                held, size = [], 0
                for doc_id, start, ids in TokenFile(r.file).read(wanted):
                    held.append((doc_id, r.start + start, ids.tobytes()))
                    size += ids.nbytes
                    if size > 8 << 20:
                        yield _frame(held)
                        held, size = [], 0
                if held:
                    yield _frame(held)

    def _frame(held):
        return pd.DataFrame(held, columns=["doc_id", "start", "ids"])

    files = manifest
    if wanted is not None:
        ids = F.lit(sorted(i for i in wanted if i is not None)).cast("array<bigint>")
        files = files.where(F.exists(ids, lambda i: i.between(F.col("first_id"), F.col("last_id"))))
    pieces, n_tokens = files.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    files = files.select("file", "start").repartition(reading_tasks(manifest.sparkSession, pieces, 4 * n_tokens))
    return null_ids(files.mapInPandas(run, "doc_id long, start long, ids binary"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read tokens."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.crc32("ids").alias("ids_crc32"))
