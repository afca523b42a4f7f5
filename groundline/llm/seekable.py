"""The public Zstandard seekable format: independent frames, then a seek table in a skippable frame.

The seek table (skippable frame 0x184D2A5E) has for each frame its compressed
size, its decompressed size and the low 32 bits of the XXH64 of its content,
then the number of frames, a descriptor byte and the magic number 0x8F92EAB1.
A reader finds it from the last nine bytes and then reads single frames.
"""

from __future__ import annotations

import struct

import pyarrow.fs as pafs
import xxhash
import zstandard

SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class Writer:
    """Writes frames one by one; ``close`` appends an optional index and the seek table."""

    def __init__(self, path: str, level: int = 3):
        fs, inner = filesystem(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self._out = fs.open_output_stream(inner, compression=None)
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.size = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Writes one frame; returns its number, file offset and compressed size."""
        packed = self._zstd.compress(data)
        at = self.size
        self._put(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self.frames) - 1, at, len(packed)

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self, index: bytes = b"") -> None:
        if index:
            packed = self._zstd.compress(index)
            self._put(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self._out.close()


class Reader:
    """Reads single frames of a seekable file and holds each against its checksum."""

    def __init__(self, path: str):
        fs, inner = filesystem(path)
        self._in = fs.open_input_file(inner)
        end = self._in.size()
        count, flags, magic = struct.unpack("<IBI", self._in.read_at(9, end - 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        begin = end - 9 - 12 * count
        self.frames = list(struct.iter_unpack("<III", self._in.read_at(12 * count, begin)))
        self.offsets = [0]
        for packed, _, _ in self.frames:
            self.offsets.append(self.offsets[-1] + packed)
        self._index = (self.offsets[-1], begin - 8)
        self._zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, size, check = self.frames[k]
        data = self._zstd.decompress(self._in.read_at(packed, self.offsets[k]), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def index(self) -> bytes:
        begin, end = self._index
        return self._zstd.decompress(self._in.read_at(end - begin - 8, begin + 8)) if end > begin else b""

    def close(self) -> None:
        self._in.close()
