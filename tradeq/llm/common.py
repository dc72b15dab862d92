"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text handled at once inside a task; a single longer text is handled alone and whole.
SLICE_BYTES = 8 << 20
#: The same where what is made of a text takes several times its memory.
SMALL = 2 << 20


def remainder(column: str, modulus: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether a row belongs to the part that is never learned from; null ids do not."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``size`` bytes, by default ``SLICE_BYTES``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(text)
        lengths = np.asarray(pc.binary_length(sizes).fill_null(0)).astype(np.int64)
        part = np.cumsum(lengths) // (size or SLICE_BYTES)
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def row_ids() -> Iterator[int]:
    """Numbers for the rows of a task, distinct over all tasks of a stage."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 33
    while True:
        yield at
        at += 1


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * ODD + h[i : i + n]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return h.view(np.int64)


def frequent_bound(counts: DataFrame, column: str, most: int) -> int:
    """The least value ``v`` so that at most ``most`` rows have ``column`` >= v.

    Reads one row per distinct value, so what reaches the driver is a histogram
    of counts; rows with equal counts are all in or all out.
    """
    least = None
    total = 0
    rows = counts.groupBy(column).count().orderBy(F.desc(column)).limit(most + 1).collect()
    for value, n in rows:
        total += n
        if total > most:
            break
        least = value
    if least is None:
        return (rows[0][0] + 1) if rows else 1
    return least
