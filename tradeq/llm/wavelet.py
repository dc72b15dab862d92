"""A wavelet matrix over token ids, and the file that holds one.

Level 0 looks at the highest bit of every id. Its bits, in order, are the first plane;
then the ids with a 0 come before those with a 1, both in their old order, and the next
level looks at the next bit. One id is followed down the planes by counting equal bits
before it (rank); an occurrence is followed up again by finding the k-th equal bit
(select). All levels together are the ids, so nothing else is stored.

File: 8 bytes mark, 4 bytes length of a JSON header, the header, then the sections it
names by offset and length. A plane is cut into blocks of ``BLOCK_BITS`` bits, each
compressed alone, with the number of 1 bits before each block. ``Matrix`` reads only the
blocks a question touches. The documents section is an Arrow stream (compressed) of ids
of any type and numbers of tokens.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

MARK = b"TQWAVE1\0"
BLOCK_BITS = 1 << 15


def _width(levels: int):
    return np.uint16 if levels <= 16 else np.uint32 if levels <= 32 else np.uint64


def planes_of(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Bits of every level, from the highest on, each in the order of that level."""
    out = []
    ids = ids.astype(_width(levels))
    for level in range(levels):
        bits = ids & ids.dtype.type(1 << (levels - 1 - level)) != 0
        out.append(bits)
        ids = np.concatenate([ids[~bits], ids[bits]])
    return out


def ids_of(planes: list[np.ndarray], n: int) -> np.ndarray:
    """The ids, from the bits of every level: from the lowest plane up, each level's order is undone."""
    ids = np.zeros(n, _width(len(planes)))
    for shift, bits in enumerate(reversed(planes)):
        zeros = n - int(np.count_nonzero(bits))
        above = np.empty_like(ids)
        above[~bits] = ids[:zeros]
        above[bits] = ids[zeros:] | ids.dtype.type(1 << shift)
        ids = above
    return ids


def pack(ids: np.ndarray, documents: pa.RecordBatch) -> bytes:
    """The file of one shard. ``documents`` has ``doc_id`` and ``n_tokens`` in the order of ``ids``."""
    if len(ids) and int(ids.min()) < 0:
        raise ValueError("token ids are not negative")
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1)
    sections: list[bytes] = []
    header = {"n": len(ids), "levels": levels, "planes": []}
    at = 0

    def add(data: bytes) -> list[int]:
        nonlocal at
        sections.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(documents)
    header["documents"] = add(sink.getvalue().to_pybytes())
    for bits in planes_of(ids, levels):
        packed = np.packbits(bits)
        step = BLOCK_BITS // 8
        blocks = [press.compress(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        ones = [int(np.bitwise_count(packed[i : i + step]).sum()) for i in range(0, len(packed), step)]
        starts = np.cumsum([0, *map(len, blocks)]).astype("<i8")
        before = np.cumsum([0, *ones]).astype("<i8")
        header["planes"].append({"starts": add(starts.tobytes()), "ones": add(before.tobytes()), "bits": add(b"".join(blocks))})
    said = json.dumps(header).encode()
    return b"".join([MARK, struct.pack("<I", len(said)), said, *sections])


class Matrix:
    """Questions to one file. ``source`` is the whole file as bytes, or an open file with ``seek`` and ``read``."""

    def __init__(self, source):
        self._source = source
        if self._read(0, 8) != MARK:
            raise ValueError("not a file of token ids")
        (size,) = struct.unpack("<I", self._read(8, 4))
        self._header = json.loads(self._read(12, size))
        self._base = 12 + size
        self.n, self.levels = self._header["n"], self._header["levels"]
        self._open = zstandard.ZstdDecompressor()
        self._block = lru_cache(maxsize=256)(self._load)
        planes = self._header["planes"]
        self._starts = [np.frombuffer(self._section(p["starts"]), "<i8") for p in planes]
        self._ones = [np.frombuffer(self._section(p["ones"]), "<i8") for p in planes]

    def _read(self, at: int, size: int) -> bytes:
        if isinstance(self._source, (bytes, bytearray, memoryview)):
            return bytes(self._source[at : at + size])
        self._source.seek(at)
        return self._source.read(size)

    def _section(self, span: list[int]) -> bytes:
        return self._read(self._base + span[0], span[1])

    def _load(self, level: int, block: int) -> np.ndarray:
        a, b = self._starts[level][block : block + 2]
        data = self._section([self._header["planes"][level]["bits"][0] + int(a), int(b - a)])
        return np.frombuffer(self._open.decompress(data), np.uint8)

    def documents(self) -> pa.RecordBatch:
        with pa.ipc.open_stream(self._section(self._header["documents"])) as stream:
            return stream.read_next_batch()

    def _zeros(self, level: int) -> int:
        return self.n - int(self._ones[level][-1])

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._block(level, block)[rest >> 3] >> (7 - (rest & 7))) & 1

    def _ones_before(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        count = int(self._ones[level][block])
        if rest:
            data = self._block(level, block)
            count += int(np.bitwise_count(data[: rest >> 3]).sum())
            if rest & 7:
                count += (int(data[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return count

    def _place_of(self, level: int, bit: int, k: int) -> int:
        """Place of the bit equal to ``bit`` that has ``k`` such bits before it."""
        before = self._ones[level]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, block))[: self.n - block * BLOCK_BITS]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones_before(level, i)
            value = value << 1 | bit
            i = self._zeros(level) + ones if bit else i - ones
        return value

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the copies of ``token`` from places ``start`` to ``end`` stand below the last level."""
        for level in range(self.levels):
            a, b = self._ones_before(level, start), self._ones_before(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self._zeros(level) + a, self._zeros(level) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` stands at places ``start`` up to but not including ``end``."""
        end = self.n if end is None else min(end, self.n)
        if token < 0 or token >> self.levels or start >= end:
            return 0
        a, b = self._span(token, start, end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the occurrence of ``token`` that has ``k`` others before it."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._span(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            if token >> (self.levels - 1 - level) & 1:
                at = self._place_of(level, 1, at - self._zeros(level))
            else:
                at = self._place_of(level, 0, at)
        return at

    def occurrences(self, token: int) -> list[int]:
        """Places of all occurrences of ``token``."""
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane."""
        planes = []
        for level in range(self.levels):
            blocks = [self._load(level, b) for b in range(len(self._starts[level]) - 1)]
            bits = np.unpackbits(np.concatenate(blocks)) if blocks else np.empty(0, np.uint8)
            planes.append(bits[: self.n] == 1)
        return ids_of(planes, self.n)
