"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; the footer has the seek table and an index from record
identifiers to frame and offset within the frame, so that single records are read alone. Of records
with equal payloads of at least `least_bytes`, that of the largest page_id is a response and the others
are revisits of it, which name its record and leave the payload out.

Defined results: a null html is an empty payload; a null page_id yields records that never serve as
the response of others while one with an id exists; where the largest page_id of a payload occurs in
several rows, each of them is a response. A payload is stored whole, however long. Without pages there are
no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.files import one_file_per_task, open_input, open_output, to_batch
from hirelake.llm.frames import FrameReader, FrameWriter
from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.session import fresh_path
from hirelake.sources.staging import stage

FRAME_BYTES = 1 << 18
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("file", pa.string()), ("number", pa.int32()), ("records", pa.int64())])
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC 1.1 record; the HTTP header of a revisit still says how long the payload is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        fields += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Fields, HTTP fields and payload of the record at `start`, and where the next one begins."""
    head = data.index(b"\r\n\r\n", start)
    fields = _fields(data[start:head])
    end = head + 4 + int(fields["content-length"])
    split = data.index(b"\r\n\r\n", head + 4, end)
    return fields, _fields(data[head + 4 : split]), data[split + 4 : end], end + 4


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


class BundleWriter:
    """Groups records into frames and notes where each one stands."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self._frames, self._most = FrameWriter(sink), frame_bytes
        self._index: list[tuple[str, int, int, int]] = []
        self._body: list[bytes] = []
        self._size = 0

    @property
    def records(self) -> int:
        return len(self._index)

    def add(self, name: str, body: bytes) -> None:
        if self._size and self._size + len(body) > self._most:
            self._flush()
        self._index.append((name, self._frames.frames, self._size, len(body)))
        self._body.append(body)
        self._size += len(body)

    def _flush(self) -> None:
        self._frames.add(b"".join(self._body))
        self._body, self._size = [], 0

    def close(self) -> None:
        if self._body:
            self._flush()
        self._frames.close(json.dumps(self._index).encode())


class BundleReader:
    """Reads records of one bundle by name, or all of them."""

    def __init__(self, source):
        self._frames = FrameReader(source)
        self.index: list[tuple[str, int, int, int]] = [tuple(x) for x in json.loads(self._frames.index())]

    def get(self, name: str) -> list[bytes]:
        """The records of that name; only their frames are decompressed."""
        return [self._frames.frame(f)[at : at + size] for n, f, at, size in self.index if n == name]

    def all(self) -> Iterator[bytes]:
        held, body = -1, b""
        for _, frame, at, size in self.index:
            if frame != held:
                held, body = frame, self._frames.frame(frame)
            yield body[at : at + size]


def with_references(pages: DataFrame, least_bytes: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, digest, rep: the largest page_id of the payload where it occurs repeatedly.

    Payload digests are counted map-side first. Only the digests that occur more than once are joined
    back: as a broadcast up to a checked number, else by a join that spreads the hot ones.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
    counted = large.agg(F.max("page_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    repeated = stage(counted.filter("copies > 1").drop("copies"), "repeated-payloads")
    if repeated.count() <= broadcast_rows:
        return rows.join(F.broadcast(repeated), "digest", "left")
    heavy = heavy_keys(rows.select("digest"), {"digest": ["digest"]})["digest"]
    return left_join_default(rows, repeated, ["digest"], heavy=heavy, salt_by=["page_id", "url"])


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write a record per page; returns the stored manifest: file, number, records."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(batches):
        number, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    path, sink = open_output(folder, f"pages-{number:06d}", ".warc.zst")
                    writer = BundleWriter(sink)
                page_id, payload, rep = row["page_id"], row["html"].encode(), row["rep"]
                revisit = rep is not None and rep != page_id
                body = record(page_id, row["url"], payload, row["digest"], rep, revisit)
                writer.add(_name(page_id), body)
        if writer is not None:
            writer.close()
            yield to_batch([(path, number, writer.records)], _MANIFEST)

    rows = with_references(pages, least_bytes).select("page_id", "url", "html", "digest", "rep")
    return stage(rows.mapInArrow(run, "file string, number int, records long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read all bundles back and check the payload of every response against its digest."""

    def run(batches):
        for batch in batches:
            for entry in batch.to_pylist():
                rows = []
                with open_input(entry["file"]) as source:
                    for body in BundleReader(source).all():
                        fields, http, payload, _ = parse(body)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind, size = fields["warc-type"], int(http["content-length"])
                        if kind == "response":
                            size, found = len(payload), hashlib.sha1(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
                        refers_to = _page(fields.get("warc-refers-to"))
                        rows.append((_page(fields["warc-record-id"]), size, digest, kind, refers_to))
                yield to_batch(rows, _RESULT)

    dealt = one_file_per_task(manifest.select("file", "number"), manifest.count())
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
