"""Token ids of documents in seekable Zstandard files, in ascending order of doc_id.

A frame holds whole documents; its index says in which frame each document stands and where. Documents
are sorted by ranges, so files are written side by side and file numbers follow the order. A file
counts once the manifest names it: what a lost or repeated task wrote is never read.

Rows of the same doc_id, or without one, are ordered by the first characters of their texts, then by a
hash of the text, then by the input partition they come from; so many of them span several files.

Defined results: a null text is an empty one, so it has the end id alone; a null doc_id comes first and is
told from every number; rows of the same doc_id follow each other in the order above; without documents
there are no rows. Texts of any length are encoded whole. An id that does not fit the width raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hirelake.llm.files import one_file_per_task, open_input, open_output, to_batch
from hirelake.llm.frames import FrameReader, FrameWriter
from hirelake.llm.tokens import encoder, id_bound, share_vocabulary
from hirelake.session import fresh_path
from hirelake.sources.staging import stage

FRAME_TOKENS = 1 << 16
FIRST_CHARACTERS = 32
_RECORD = np.dtype([("doc_id", "<i8"), ("no_id", "<u1"), ("frame", "<u4"), ("first", "<u8"), ("tokens", "<u8")])
_KIND, _HEAD = b"TID2", struct.Struct("<4sB")
_MANIFEST = pa.schema([("file", pa.string()), ("number", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class TokenWriter:
    """Writes one file; `width` is 2 bytes an id where all ids fit, else 4."""

    def __init__(self, sink, width: int, frame_tokens: int = FRAME_TOKENS):
        self._frames, self._type, self._most = FrameWriter(sink), np.dtype(f"<u{width}"), frame_tokens
        self._records: list[tuple[int, bool, int, int, int]] = []
        self._body: list[bytes] = []
        self._size = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self._size and self._size + len(ids) > self._most:
            self._flush()
        if len(ids) and int(ids.max()) > np.iinfo(self._type).max:
            raise ValueError(f"id {ids.max()} does not fit {self._type.itemsize} bytes")
        self._records.append((doc_id or 0, doc_id is None, self._frames.frames, self._size, len(ids)))
        self._body.append(ids.astype(self._type).tobytes())
        self._size += len(ids)
        self.tokens += len(ids)

    @property
    def documents(self) -> int:
        return len(self._records)

    def _flush(self) -> None:
        self._frames.add(b"".join(self._body))
        self._body, self._size = [], 0

    def close(self) -> None:
        if self._body:
            self._flush()
        records = np.array(self._records, dtype=_RECORD).tobytes()
        self._frames.close(_HEAD.pack(_KIND, self._type.itemsize) + records)


class TokenReader:
    """Reads documents of one file, decompressing only the frames that hold them."""

    def __init__(self, source):
        self._frames = FrameReader(source)
        index = self._frames.index()
        kind, width = _HEAD.unpack_from(index)
        if kind != _KIND:
            raise ValueError("not a token file")
        self._type = np.dtype(f"<u{width}")
        self.records = np.frombuffer(index, dtype=_RECORD, offset=_HEAD.size)

    def _read(self, records: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        held, ids = -1, np.empty(0, self._type)
        for record in records:
            if record["frame"] != held:
                held = int(record["frame"])
                ids = np.frombuffer(self._frames.frame(held), dtype=self._type)
            first = int(record["first"])
            yield None if record["no_id"] else int(record["doc_id"]), ids[first : first + int(record["tokens"])].astype("<u4")

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        return self._read(self.records)

    def only(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        return self._read(self.records[np.isin(self.records["doc_id"], list(doc_ids)) & (self.records["no_id"] == 0)])


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, width: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the stored manifest: file, number, documents, tokens.

    An id takes `width` bytes, by default 2 where all ids of the vocabulary and the end id fit, else 4.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    width = width or (2 if max(id_bound(vocabulary), end_id + 1) <= 1 << 16 else 4)
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        number = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            encoded = encoder(shared).encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                if writer is None:
                    path, sink = open_output(folder, f"tokens-{number:06d}", ".zst")
                    writer = TokenWriter(sink, width)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield to_batch([(path, number, writer.documents, writer.tokens)], _MANIFEST)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    ties = {"_head": F.substring(text, 1, FIRST_CHARACTERS), "_hash": F.xxhash64(text), "_from": F.spark_partition_id()}
    order = ["doc_id", *ties]
    ordered = rows.withColumns(ties).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ordered.mapInArrow(run, "file string, number int, documents long, tokens long")
    return stage(written, "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read all files back: doc_id, start, n_tokens, ids_crc32. The manifest has one row per file."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")

    def run(batches):
        for batch in batches:
            for entry in batch.to_pylist():
                with open_input(entry["file"]) as source:
                    rows, start = [], entry["first"]
                    for doc_id, ids in TokenReader(source).all():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                yield to_batch(rows, _RESULT)

    files = manifest.select("file", "number", first.alias("first"))
    dealt = one_file_per_task(files, manifest.count())
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
