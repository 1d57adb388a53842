"""WARC archives: written by tasks, read back by byte ranges.

Archives are WARC/1.1 with a gzip member per record. Records of equal payloads
(from ``MIN_REVISIT`` bytes on) are written once: the smallest id is a
response, the others are revisits that refer to it and keep the HTTP header
with the payload's length and digest.

The reader splits archives in byte ranges that know nothing of records. A task
looks for the gzip magic in its range, takes a place for a member only if what
is there decodes to a WARC header, and owns the records that start in its
range, reading past the range's end to finish the last. So every record is read
once, whatever the ranges are.

A task names its archives anew and an archive counts once its manifest row is
committed, so a task that runs again leaves nothing that is read.

Defined cases: a null payload is empty; a null id is never a response that
others refer to, unless its group has no other id, in which case all of the
group are responses; rows that share the smallest id are all responses; a null
or odd URL is left out or percent-encoded; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import reading_tasks, written
from ranklane.llm.files import open_read, open_write
from ranklane.session import scratch_path

MIN_REVISIT = 100
#: bytes of an archive at which the next is begun, and of a reader's range
ARCHIVE = 256 << 20
RANGE = 16 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit if it refers to a page."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if revisit:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = http if revisit else http + payload
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a
    decompressed record; a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:>" else None
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To"))


def _member(data: bytes, at: int, more) -> tuple[bytes, int] | None:
    """(content, packed size) of the gzip member at ``at``; None if there is no
    WARC record. ``more`` gives the bytes after ``data``, bit by bit."""
    reader, pos, out = zlib.decompressobj(31), at, b""
    step = 512  # decode a little first: most places that look like gzip end there
    held = []
    try:
        while not reader.eof:
            feed = data[pos:pos + step]
            if not feed:
                feed = more()
                if not feed:
                    return None
            out = reader.decompress(feed)
            pos += len(feed)
            held.append(out)
            if step == 512:
                head = b"".join(held)
                if not b"WARC/1.".startswith(head[:7]):
                    return None
                if len(head) >= 7:
                    step = 1 << 20
    except zlib.error:
        return None
    content = b"".join(held)
    return (content, pos - at - len(reader.unused_data)) if content.startswith(b"WARC/1.") else None


def records_of(uri: str, start: int, end: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the records that start in bytes ``start`` to ``end``."""
    with open_read(uri) as f:
        f.seek(start)
        # a magic may lie across the range's end
        data, at = f.read(end - start + len(_MAGIC) - 1), 0
        owned = end - start
        while True:
            at = data.find(_MAGIC, at)
            if at < 0 or at >= owned:
                return
            f.seek(start + len(data))
            if (found := _member(data, at, lambda: f.read(block))) is None:
                at += 1
            else:
                yield found[0]
                at += found[1]


def with_references(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload) with ``refers_to``, the smallest id of the same
    payload for all others. Only payloads that occur again are joined, spread
    over ``SALTS`` so that a payload of very many pages is no hot key."""
    digest = pages.withColumn("digest", F.sha2("payload", 256))
    again = (digest.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
             .select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")))
    salted = digest.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return salted.join(again, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive: int = ARCHIVE) -> DataFrame:
    """Writes a record per row; the manifest: (file, n_bytes, n_records)."""
    folder = scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, uri, size, n = TaskContext.get().partitionId(), None, None, 0, 0
        for rows in batches:
            refers = [None if pd.isna(x) else int(x) for x in rows["refers_to"]]
            ids = [None if pd.isna(x) else int(x) for x in rows["page_id"]]
            for page_id, url, payload, ref in zip(ids, rows["url"], rows["payload"], refers):
                if out is None:
                    uri = f"{folder}/part-{part:07d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = open_write(uri), 0, 0
                made = record(page_id, url, payload, ref)
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= archive:
                    out.close()
                    out = None
                    yield pd.DataFrame({"file": [uri], "n_bytes": [size], "n_records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [uri], "n_bytes": [size], "n_records": [n]})

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    return written(with_references(rows).mapInPandas(run, "file string, n_bytes long, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of
    every record, read by ranges of ``size`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for rows in batches:
            for r in rows.itertuples():
                held = []
                for content in records_of(r.file, r.start, r.end):
                    held.append(parsed(content))
                    if len(held) >= 10_000:
                        yield _frame(held, names)
                        held = []
                if held:
                    yield _frame(held, names)

    def _frame(held, names):
        return pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    ranges = (manifest.where("n_bytes > 0")
              .select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(size).cast("long"))).alias("start"))
              .select("file", "start", F.least(F.col("start") + size, "n_bytes").alias("end")))
    pieces, n_bytes = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    ranges = ranges.repartition(reading_tasks(manifest.sparkSession, pieces, n_bytes))
    return ranges.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
