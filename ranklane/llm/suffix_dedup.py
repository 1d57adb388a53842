"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Sorting suffixes brings equal strings together;
three things keep that small:

* Anchors. Of the ``GRAM``-byte grams in a string of ``length`` bytes, the one
  with the smallest hash is its anchor. Equal strings have equal anchors at
  equal places, so only suffixes at anchors are sorted: about one byte in
  sixteen. A string goes with one anchor (the leftmost, of equal hashes), so a
  suffix needs only the bytes, and the left context, of the strings that go
  with its anchor.
* Repeats only. Blocks of documents first exchange the hashes of their anchors;
  suffixes whose anchor occurs in one document alone are never sent.
* Front coding. Each block sorts its suffixes into runs, one a merge part,
  and sends only what a suffix does not share with the one before it.

Each merge part combines its runs with a loser tree. Its nodes keep the length
of the prefix that a loser shares with the winner that beat it; of two
suffixes, the one that shares more with the last winner is the smaller, and
only equal lengths have bytes compared, from that length on. The merge gives
the common prefixes of neighbours, which say, for each offset of a string
around its anchor, which suffixes hold equal strings; the smallest id of those
goes back to the blocks as the offsets to remove.

Blocks are files in the shared folder, read by the tasks that need them: only
flags, runs and offsets pass through shuffles, and Spark's own memory never
holds texts. A task that runs again names its files anew, and a file counts
once its row of the table of blocks is committed.

What is held at once: a block of documents (``BLOCK`` bytes, or one longer
document), and the runs of a merge part, whose number follows the input. A
string that very many documents share is one entry a run.

Defined cases: a null text counts as empty; rows that share an id are one
document for comparison and are each judged; a row with a null id has no
place in the order: it keeps all its bytes and takes none from others.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import written
from ranklane.llm.files import open_read, open_write
from ranklane.session import scratch_path

LENGTH = 50
GRAM = 20
BLOCK = 8 << 20
#: anchors a hash bucket, and suffixes a merge part, about
BUCKET = 1 << 18
#: most tasks that a step over blocks is dealt to
TASKS = 1 << 17
_CHUNK = 1 << 17
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the ``GRAM`` bytes from each position, never 0."""
    def joined(x, nx, y):
        n = len(y) - nx
        return x[:n] * np.uint64(pow(_BASE, nx, 1 << 64)) + y[nx:]
    h = _BYTE[data]
    two = joined(h, 1, h)
    four = joined(two, 2, two)
    eight = joined(four, 4, four)
    h = joined(joined(eight, 8, eight), 16, four)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i:i+width] for every i."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:len(x) - step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(positions, hashes, least and largest offset) of the anchors of all
    strings of ``length`` bytes that lie within one document; ``ends`` are the
    documents' ends in ``data``. A string that goes with an anchor starts an
    offset before it, and every offset in the range is such a string."""
    at, h = _anchor_places(data, ends, length)
    reach = length - GRAM
    low, high = at - reach, at.copy()  # first and last start of a string
    if len(at):
        wins = h[:-1] <= h[1:]  # of two anchors in a string, the smaller hash, then the left one
        low[1:] = np.where(wins, np.maximum(low[1:], at[:-1] + 1), low[1:])
        high[:-1] = np.where(wins, high[:-1], np.minimum(high[:-1], at[1:] - reach - 1))
        doc = np.searchsorted(ends, at, "right")
        low = np.maximum(low, np.concatenate([[0], ends])[doc])
        high = np.minimum(high, ends[doc] - length)
    use = low <= high
    return at[use], h[use], (at - high)[use], (at - low)[use]


def _anchor_places(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    width = length - GRAM + 1
    found, hashes = [], []
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for at in range(0, len(data), _CHUNK):
        # the chunk with all strings whose anchor may lie in it
        low, high = max(0, at - width + 1), min(len(data), at + _CHUNK + length - 1)
        part = data[low:high]
        if len(part) < length:
            continue
        h = _gram_hashes(part)
        near = ends[np.searchsorted(ends, low, "right"):np.searchsorted(ends, high, "left") + 1]
        least = _sliding(h, width, np.minimum)
        for e in near.tolist():  # strings that would run over a document's end have no anchor
            least[max(0, e - length + 1 - low):max(0, e - low)] = 0
        # position i is an anchor if it is the least of some string that starts at i-width+1..i
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        padded[width - 1:width - 1 + len(least)] = least
        most = _sliding(padded, width, np.maximum)
        own = np.flatnonzero(most[:len(h)] == h[:len(most)]) + low
        own = own[(own >= at) & (own < at + _CHUNK)]
        found.append(own)
        hashes.append(h[own - low])
    return (np.concatenate(found), np.concatenate(hashes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _write_block(uri: str, ids: list[int], texts: list[bytes]) -> None:
    parts = [_pack(np.array(ids, np.int64)), _pack(np.array([len(t) for t in texts], np.int64)),
             zstandard.compress(b"".join(texts), 3)]
    with open_write(uri) as f:
        f.write(struct.pack("<QQQ", *map(len, parts)))
        for p in parts:
            f.write(p)


def _read_block(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, document ends, document ids) of a block."""
    with open_read(uri) as f:
        sizes = struct.unpack("<QQQ", f.read(24))
        ids, lengths = (_unpack(f.read(n), np.int64) for n in sizes[:2])
        return _unpack(f.read(sizes[2]), np.uint8), np.cumsum(lengths), ids


def blocks_of(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Documents in order of the scan, in files of about ``size`` bytes:
    (block, n_bytes, file)."""
    folder = scratch_path(docs.sparkSession, "suffix-blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            uri = f"{folder}/part-{part:07d}-{made:07d}-{uuid.uuid4().hex}.block"
            _write_block(uri, ids, texts)
            return pd.DataFrame({"block": [(part << 24) + made], "n_bytes": [held], "file": [uri]})
        for rows in batches:
            for i, t in zip(rows["doc_id"], rows["text"]):
                t = (t or "").encode("utf-8", "surrogatepass")
                if held and held + len(t) > size:
                    yield row()
                    made, ids, texts, held = made + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield row()

    return docs.mapInPandas(run, "block long, n_bytes long, file string")


def _dealt(blocks: DataFrame, *more: DataFrame) -> DataFrame:
    """Blocks with the rows of other steps for them: (block, file, kind, place,
    data), the block itself being kind 0 and the tables of ``more`` 1, 2, ... A
    given number of partitions, since rows are small beside the blocks' files."""
    rows = blocks.select("block", "file", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("place"),
                         F.lit(None).cast("binary").alias("data"))
    n = max(1, min(TASKS, blocks.count()))
    if not more:
        return rows.repartitionByRange(n, "block")
    for kind, other in enumerate(more, 1):
        place, data = other.columns[1:]
        rows = rows.union(other.select("block", F.lit(None).cast("string"), F.lit(kind), place, data))
    return rows.repartition(n, "block").groupBy("block")


def _distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of each hash in them, and whether it is in
    two documents of the block."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    return distinct, inverse, low != high


def _cut(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Bounds in sorted hashes of the classes by their top ``bits`` bits."""
    tops = (distinct >> np.uint64(64 - bits)) if bits else np.zeros(len(distinct), np.uint64)
    return np.searchsorted(tops, np.arange((1 << bits) + 1, dtype=np.uint64))


def repeated_anchors(blocks: DataFrame, bits: int, width: int, length: int) -> DataFrame:
    """(block, bucket, flags): for a block's distinct anchor hashes with these
    top bits, in order, whether the hash is in two documents anywhere. Hashes
    travel with ``width`` bytes after the top bits; a chance match costs a
    suffix sent in vain, nothing else."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                data, ends, ids = _read_block(r.file)
                at, hashes, _, _ = anchors(data, ends, length)
                distinct, _, twice = _distinct(hashes, ids[np.searchsorted(ends, at, "right")])
                cut = _cut(distinct, bits)
                short = ((distinct << np.uint64(bits)) >> np.uint64(64 - 8 * width)).astype("<u8")
                short = short.view(np.uint8).reshape(-1, 8)[:, :width]
                some = np.flatnonzero(cut[1:] > cut[:-1])
                yield pd.DataFrame({"bucket": some, "block": r.block,
                                    "hashes": [short[cut[b]:cut[b + 1]].tobytes() for b in some],
                                    "twice": [np.packbits(twice[cut[b]:cut[b + 1]]).tobytes() for b in some]})

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(h, np.uint8).reshape(-1, width) for h in rows["hashes"]]
        sizes = [len(x) for x in raw]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :width] = np.concatenate(raw)
        _, inverse, n = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        flag = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=s) for t, s in zip(rows["twice"], sizes)])
        more = n > 1
        more |= np.bincount(inverse, flag, len(n)) > 0
        back = np.split(more[inverse], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"],
                             "flags": [np.packbits(b).tobytes() for b in back]})

    sent = _dealt(blocks).mapInPandas(send, "bucket int, block long, hashes binary, twice binary")
    return sent.groupBy("bucket").applyInPandas(count, "block long, bucket int, flags binary")


def _contexts(data, at, least, most, length) -> np.ndarray:
    """A row per anchor: the suffix, the left context backwards, and how many
    bytes of each belong to strings of the anchor (the others are 0)."""
    left = length - GRAM
    padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, left + length)
    out = np.zeros((len(at), length + left + 2), np.uint8)
    for lo in range(0, len(at), _CHUNK >> 2):
        some = slice(lo, lo + (_CHUNK >> 2))
        both, part = windows[at[some]], out[some]
        part[:, :length] = both[:, left:]
        part[:, length:length + left] = both[:, :left][:, ::-1]
        part[:, :length][np.arange(length) >= (length - least[some])[:, None]] = 0
        part[:, length:length + left][np.arange(left) >= most[some][:, None]] = 0
    out[:, -2], out[:, -1] = length - least, most
    return out


def _shared_prefix(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def _sorted_rows(keys: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


class _Suffixes:
    """The sorted suffixes of a block whose anchors are in two documents."""

    def __init__(self, rows: pd.DataFrame, bits: int, length: int):
        """``rows``: a block's row and those of its flags, as ``_dealt``."""
        self.block = int(rows["block"].iloc[0])
        self.data, self.ends, self.ids = _read_block(rows["file"][rows["kind"] == 0].iloc[0])
        at, hashes, least, most = anchors(self.data, self.ends, length)
        doc = self.ids[np.searchsorted(self.ends, at, "right")]
        distinct, inverse, _ = _distinct(hashes, doc)
        cut, repeated = _cut(distinct, bits), np.zeros(len(distinct), bool)
        flags = rows[rows["kind"] == 1]
        for bucket, bits_of in zip(flags["place"].astype(int), flags["data"]):
            lo, hi = cut[bucket], cut[bucket + 1]
            repeated[lo:hi] = np.unpackbits(np.frombuffer(bits_of, np.uint8), count=hi - lo)
        use = repeated[inverse]
        at, least, most, doc = at[use], least[use], most[use], doc[use]
        part = (hashes[use] >> np.uint64(64 - bits)).astype(np.int64)
        keys = _contexts(self.data, at, least, most, length)
        order = _sorted_rows(keys)
        order = order[np.argsort(part[order], kind="stable")]
        self.at, self.least, self.most, self.doc = at[order], least[order], most[order], doc[order]
        keys, part = keys[order], part[order]
        shared = _shared_prefix(keys)
        shared[np.concatenate([[False], part[1:] != part[:-1]])[:len(shared)]] = 0
        new = shared < keys.shape[1]
        #: the entry (distinct context) of each suffix, and per entry its
        #: context, shared prefix, merge part and smallest document
        self.entry, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.keys, self.shared, self.part = keys[first], shared[first], part[first]
        self.low = np.minimum.reduceat(self.doc, first) if len(first) else np.zeros(0, np.int64)


def suffix_runs(blocks: DataFrame, flags: DataFrame, bits: int, length: int) -> DataFrame:
    """Front-coded sorted runs, one a block and merge part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _Suffixes(rows, bits, length)
        bounds = np.flatnonzero(np.concatenate([[True], s.part[1:] != s.part[:-1], [True]])) if len(s.part) else []
        made = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            tails = s.keys[lo:hi][np.arange(s.keys.shape[1]) >= s.shared[lo:hi, None]]
            made.append((int(s.part[lo]), s.block, int(hi - lo), _pack(s.shared[lo:hi].astype(np.uint8)),
                         _pack(tails), _pack(s.low[lo:hi])))
        return pd.DataFrame(made, columns=["part", "block", "n", "shared", "tails", "docs"])

    return _dealt(blocks, flags).applyInPandas(run, "part int, block long, n int, shared binary, tails binary, docs binary")


def _decoded(shared: list[int], tails: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(shared prefix, key) of a front-coded run."""
    key, at = b"", 0
    for h in shared:
        key = key[:h] + tails[at:at + width - h]
        at += width - h
        yield h, key


def merged(runs: list[tuple[list[int], bytes]], width: int) -> tuple[list[int], list[int], list[bytes]]:
    """Merges front-coded sorted runs with a loser tree: the run each key came
    from, the prefix it shares with the key before, and the keys, in order."""
    k = 1
    while k < len(runs):
        k *= 2
    streams = [_decoded(s, t, width) for s, t in runs]
    end = width + 1  # an ended run shares nothing and loses to all
    keys: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, s in enumerate(streams):
        keys[i] = next(s, (0, None))[1]
    losers = [0] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is set to that with the winner."""
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h, g = shared[a], shared[b]
        if h != g:
            return (a, b) if h > g else (b, a)
        if x == y:
            shared[max(a, b)] = width
            return (a, b) if a < b else (b, a)
        differ = int.from_bytes(x[h:], "big") ^ int.from_bytes(y[h:], "big")
        g = width - (differ.bit_length() + 7) // 8
        if x[g] < y[g]:
            shared[b] = g
            return a, b
        shared[a] = g
        return b, a

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = duel(play(2 * node), play(2 * node + 1))
        return winner

    best = play(1)
    from_run, common, out = [], [], []
    while keys[best] is not None:
        from_run.append(best)
        common.append(shared[best])
        out.append(keys[best])
        shared[best], keys[best] = next(streams[best], (0, None))
        node = (best + k) >> 1
        while node:
            other = losers[node]
            # as duel(), written out for the common case that lengths decide
            y = keys[other]
            if y is not None:
                if keys[best] is None or shared[other] > shared[best]:
                    losers[node], best = best, other
                elif shared[other] == shared[best]:
                    best, losers[node] = duel(best, other)
            node >>= 1
    return from_run, common, out


def _offsets(common: np.ndarray, keys: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset o for each merged entry such that the string
    that starts o bytes before the anchor is in a document with a smaller id
    than ``low``; 255 and 0 if there is none."""
    left = length - GRAM
    n = len(low)
    right_n, left_n = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    least, most = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
    # rank of the left contexts within each anchor's group
    group = np.cumsum(common < GRAM).astype(">u4")
    by_left = np.concatenate([group.view(np.uint8).reshape(n, 4), keys[:, length:length + left]], axis=1)
    order = _sorted_rows(by_left)
    left_common = _shared_prefix(by_left[order])
    for o in range(left + 1):
        use = np.flatnonzero((o <= left_n) & (length - o <= right_n))
        if not len(use):
            continue
        right_rank = np.cumsum(common < length - o)
        left_rank = np.empty(n, np.int64)
        left_rank[order] = np.cumsum(left_common < 4 + o)
        both = right_rank[use] * (n + 1) + left_rank[use]
        by = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], both[by][1:] != both[by][:-1]]))
        smallest = np.minimum.reduceat(low[use][by], first)
        hit = use[by][np.repeat(smallest, np.diff(np.append(first, len(by)))) < low[use][by]]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    return least, most


def earlier_strings(runs: DataFrame, length: int) -> DataFrame:
    """(block, part, offsets): for each entry of a run, the least and largest
    offset of a string that a smaller document also has."""
    width = 2 * length - GRAM + 2

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        packed = [(_unpack(r.shared, np.uint8).tolist(), zstandard.decompress(r.tails)) for r in rows.itertuples()]
        from_run, common, keys = merged(packed, width)
        del packed
        from_run = np.array(from_run)
        order = np.argsort(from_run, kind="stable")  # a run's entries come out in its order
        low = np.empty(len(order), np.int64)
        low[order] = np.concatenate([_unpack(d, np.int64) for d in rows["docs"]])
        table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
        least, most = _offsets(np.array(common), table, low, length)
        both = np.stack([least, most], axis=1)[order]
        back = np.split(both, np.cumsum(rows["n"].to_numpy())[:-1])
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "offsets": [_pack(b) for b in back]})

    return runs.groupBy("part").applyInPandas(merge, "block long, part int, offsets binary")


def _covered(rows: pd.DataFrame, bits: int, length: int) -> tuple[_Suffixes, np.ndarray]:
    """A block's suffixes, and which of its bytes go."""
    s = _Suffixes(rows, bits, length)
    marks = np.zeros(len(s.data) + 1, np.int32)
    if len(s.at):
        found = rows[rows["kind"] == 2].sort_values("place")["data"]
        offsets = np.concatenate([_unpack(o, np.uint8).reshape(-1, 2) for o in found])[s.entry]
        later = s.doc > s.low[s.entry]  # the entry's own first document has all its strings
        least, most = np.where(later, s.least, offsets[:, 0]), np.where(later, s.most, offsets[:, 1])
        use = least <= most
        # strings around one anchor overlap, so together they are one stretch
        np.add.at(marks, (s.at - most)[use], 1)
        np.add.at(marks, (s.at - least + length)[use], -1)
    return s, np.cumsum(marks[:-1], dtype=np.int32) > 0


def without_covered(blocks: DataFrame, flags: DataFrame, offsets: DataFrame, bits: int, length: int, as_text: bool) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s, gone = _covered(rows, bits, length)
        data, ends, ids = s.data, s.ends, s.ids
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]
        begins[starts[starts < len(gone)]] = gone[starts[starts < len(gone)]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        removed = total[ends] - total[starts]
        kept = [data[s:e].tobytes() if not n else data[s:e][~gone[s:e]].tobytes()
                for s, e, n in zip(starts.tolist(), ends.tolist(), removed.tolist())]
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        out = {"doc_id": ids, "n_bytes": ends - starts, "n_removed": removed, "n_spans": spans[ends] - spans[starts], "kept": kept}
        if as_text:
            out["digest"] = np.array([xxhash.xxh64_intdigest(data[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist())],
                                     np.uint64).view(np.int64)
        return pd.DataFrame(out)

    return _dealt(blocks, flags, offsets).applyInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string, digest long" if as_text else "binary"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: ``kept`` is
    the UTF-8 bytes that stay, or the text they make, without what is left of
    characters that were cut. With texts also ``digest``, Spark's xxhash64 of
    the input text (of an empty one for a null), which tells apart rows that
    share an id."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = written(blocks_of(rows.where("doc_id is not null")), "suffix-table")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    expected = total * 2 // (length - GRAM + 2)
    bits = max(2, (expected // BUCKET).bit_length())
    width = min(8 - (bits + 7) // 8, max(4, (total.bit_length() + 12 - bits + 7) // 8))
    flags = written(repeated_anchors(blocks, bits, width, length), "suffix-flags")
    offsets = written(earlier_strings(suffix_runs(blocks, flags, bits, length), length), "suffix-offsets")
    out = without_covered(blocks, flags, offsets, bits, length, as_text)
    text = F.coalesce("text", F.lit(""))
    alone = rows.where("doc_id is null").select("doc_id", (text if as_text else F.encode(text, "UTF-8")).alias("kept"),
                                                F.xxhash64(text).alias("digest"))
    alone = alone.select("doc_id", F.octet_length("kept").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "kept", "digest")
    return out.union(alone if as_text else alone.drop("digest"))
