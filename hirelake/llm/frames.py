"""Seekable Zstandard files: independent frames, an index frame and a seek table at the end.

The layout is the public seekable format: data frames, then skippable frames. The seek table holds for
each frame its compressed size, its size and the low 32 bits of the XXH64 of its content; the last nine
bytes say how many frames there are. The frame before the table is a skippable one with an index of
whatever the frames hold. Any Zstandard reader decompresses the file as a whole.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import xxhash
import zstandard

# Fixed values of the public format.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_ENTRY = struct.Struct("<III")
_HEADER = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")


def _check(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Appends frames to a stream; `close` adds the index and the seek table."""

    def __init__(self, sink: BinaryIO, level: int = 3):
        self._sink = sink
        self._compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._entries: list[bytes] = []

    @property
    def frames(self) -> int:
        return len(self._entries)

    def add(self, content: bytes) -> None:
        packed = self._compressor.compress(content)
        self._sink.write(packed)
        self._entries.append(_ENTRY.pack(len(packed), len(content), _check(content)))

    def close(self, index: bytes) -> None:
        packed = self._compressor.compress(index)
        self._sink.write(_HEADER.pack(INDEX_MAGIC, len(packed)) + packed)
        self._entries.append(_ENTRY.pack(len(packed) + _HEADER.size, 0, _check(b"")))
        table = b"".join(self._entries)
        self._sink.write(_HEADER.pack(TABLE_MAGIC, len(table) + _FOOTER.size) + table)
        self._sink.write(_FOOTER.pack(len(self._entries), CHECKSUMS, FOOTER_MAGIC))
        self._sink.close()


class FrameReader:
    """Reads single frames of a file with random access; every content is checked."""

    def __init__(self, source):
        self._source = source
        self._decompressor = zstandard.ZstdDecompressor()
        size = source.seek(0, 2) or source.tell()
        count, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(size - _FOOTER.size - count * _ENTRY.size, count * _ENTRY.size)
        self._entries = list(_ENTRY.iter_unpack(table))
        self._starts = [0]
        for packed, _, _ in self._entries:
            self._starts.append(self._starts[-1] + packed)

    def __len__(self) -> int:
        return len(self._entries) - 1

    def _at(self, start: int, size: int) -> bytes:
        self._source.seek(start)
        return self._source.read(size)

    def frame(self, number: int) -> bytes:
        packed, size, check = self._entries[number]
        content = self._decompressor.decompress(self._at(self._starts[number], packed), max_output_size=size)
        if len(content) != size or _check(content) != check:
            raise ValueError(f"frame {number} is damaged")
        return content

    def index(self) -> bytes:
        packed = self._entries[-1][0]
        body = self._at(self._starts[-2] + _HEADER.size, packed - _HEADER.size)
        return self._decompressor.decompress(body)
