"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Spark orders the vectors by label and place on a Hilbert curve, and writes them as
Parquet in blocks of up to ``BLOCK`` rows of one label. Each block carries its zone map: the
least and greatest value of every dimension. For an anchor, interval arithmetic over a
zone map bounds the inner products with all rows of the block, so a block is read only if
its bounds reach one of the anchor's windows above what that window has found already.

Anchors are dealt to tasks in the same order, so the anchors of a task lie near each
other. A task first finds the positives of its anchors in the blocks of their label, then the
negatives of all windows in the other blocks, files and blocks with the best bounds
first; it holds one panel of blocks and the best rows so far. Nothing but anchors is shuffled for the search,
and a lost task reads its blocks again from the shared folder.

Components are whole numbers (floor of ``scale`` times the value). Products are exact:
in 32 or 64-bit floating point where the norms prove that every partial sum is a whole
number such a type can hold, else in Python's integers; scores beyond 64 bits are told as
the nearest 64-bit number, components beyond 1e150 count as 1e150.

Rows with a null id, label, vector or component, or a component that is not finite, take
no part. An empty vector is one of zeros, as vectors of different lengths are read as
ending in zeros. Ids are whole numbers. Rows that share an anchor's id are the anchor
itself, never a positive or negative of it; of repeated anchors each is answered, with
equal rows. Other columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeq.llm import shared_files
from tradeq.session import shared_dir

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score in hundredths of the positive's, from and to.
LOW, HIGH = 30, 90
BLOCK, PANEL_ROWS, ANCHORS_AT_ONCE = 1024, 1 << 14, 512
#: Cells of the curve along each dimension, as a power of two.
CURVE_BITS = 2
#: Greater components count as this one; products of two stay far inside a double's range.
MOST = 1e150


def hilbert_keys(vectors: np.ndarray, scale: float = SCALE, bits: int = CURVE_BITS) -> list[bytes]:
    """Place of each vector on a Hilbert curve over ``2**bits`` cells a dimension, as sortable bytes.

    Cells are narrow where components of unit vectors are frequent. The curve follows
    from exchanging and inverting low bits from the highest bit down, then a Gray code.
    """
    n, d = vectors.shape
    if not d:
        return [b""] * n
    spread = np.arctan(vectors / scale * np.sqrt(d) * 1.5) / np.pi + 0.5
    x = np.clip((spread * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of different lengths as one matrix, zeros at the ends."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _whole(df: DataFrame, scale: int, vector: str, label: str, key: str, new_label) -> DataFrame:
    """Usable rows as (label, curve, id, vector of whole numbers)."""
    label_type = df.schema[label].dataType
    rows = df.select(
        F.col(label).alias("label"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).filter("label is not null and id is not null and v is not null")
    if new_label is not None:
        rows = rows.withColumn("label", new_label(F.col("id"), F.col("label")).cast(label_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
            ends = ends.astype(np.int64)
            keep = np.flatnonzero(bad[ends] == bad[starts])
            if not len(keep):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(values * float(scale)), -MOST, MOST)
            vectors = _matrix([whole[starts[i] : ends[i]] for i in keep])
            sizes = (ends - starts)[keep]
            data = [vectors[j, :s].tobytes() for j, s in enumerate(sizes)]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(at), pa.array(hilbert_keys(vectors, scale), pa.binary()), batch.column("id").take(at), pa.array(data, pa.binary())],
                names=["label", "curve", "id", "v"],
            )

    schema = T.StructType(
        [T.StructField("label", label_type), T.StructField("curve", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())]
    )
    return rows.mapInArrow(run, schema)


def _smallest(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def write_blocks(whole: DataFrame, block: int = BLOCK) -> str:
    """Rows of ``_whole`` in order, as one Parquet row per block; returns the folder."""
    ordered = whole.repartitionByRange("label", "curve", "id").sortWithinPartitions("label", "curve", "id")
    label_type = whole.schema["label"].dataType
    fields = [("n", T.IntegerType()), ("d", T.IntegerType()), ("kind", T.StringType())]
    fields += [(c, T.BinaryType()) for c in ("low", "high", "ids", "vectors")]
    schema = T.StructType([T.StructField("label", label_type), *[T.StructField(c, t) for c, t in fields]])

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole_block = pa.Table.from_batches(rows).combine_chunks()
        vectors = _smallest(_matrix([np.frombuffer(v, np.float64) for v in whole_block.column("v").to_pylist()]))
        ids = whole_block.column("id").to_numpy().astype("<i8")
        made = [len(ids), vectors.shape[1], vectors.dtype.str, vectors.min(0).tobytes(), vectors.max(0).tobytes(), ids.tobytes(), vectors.tobytes()]
        arrays = [pa.array([x]) for x in made]
        arrays[0], arrays[1] = arrays[0].cast(pa.int32()), arrays[1].cast(pa.int32())
        return pa.RecordBatch.from_arrays([whole_block.column("label").combine_chunks().slice(0, 1), *arrays], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        label = None
        for batch in batches:
            labels = batch.column("label").to_pylist()
            at = 0
            while at < batch.num_rows:
                if held and labels[at] != label:
                    yield one(held)
                    held = []
                label = labels[at]
                end = at
                room = block - sum(h.num_rows for h in held)
                while end < batch.num_rows and end - at < room and labels[end] == label:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
                if sum(h.num_rows for h in held) >= block:
                    yield one(held)
                    held = []
        if held:
            yield one(held)

    folder = shared_dir(whole.sparkSession, "vector-blocks")
    # a row group holds some blocks, so single blocks can be read without the rest of a file
    ordered.mapInArrow(run, schema).write.option("parquet.block.size", 1 << 20).parquet(folder)
    return folder


class Blocks:
    """The block files as a task reads them: zone maps first, vectors only of the blocks asked for."""

    def __init__(self, folder: str):
        self.system, _ = shared_files.place(folder)
        self.paths = shared_files.files(folder, ".parquet")
        self.read = 0

    @lru_cache(maxsize=64)  # noqa: B019 - lives as long as its task
    def _file(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.system.open_input_file(path))

    def zones(self, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """Per row group of a file: places (file, row group, row), labels, lows and highs."""
        file = self._file(path)
        for g in range(file.num_row_groups):
            part = file.read_row_group(g, columns=["label", "kind", "low", "high"]).to_pydict()
            lows = _matrix([np.frombuffer(x, k) for x, k in zip(part["low"], part["kind"])])
            highs = _matrix([np.frombuffer(x, k) for x, k in zip(part["high"], part["kind"])])
            yield [(path, g, i) for i in range(len(lows))], np.array(part["label"], object), lows, highs

    def rows(self, places: list[tuple[str, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors of blocks."""
        by_group: dict[tuple[str, int], list[int]] = {}
        for path, g, i in places:
            by_group.setdefault((path, g), []).append(i)
        for (path, g), wanted in by_group.items():
            part = self._file(path).read_row_group(g, columns=["n", "d", "kind", "ids", "vectors"]).take(pa.array(wanted)).to_pydict()
            for n, d, kind, ids, vectors in zip(*part.values()):
                self.read += 1
                yield np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(n, d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of whole-numbered rows, as int64 or Python integers."""
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, b))
    # by Cauchy and Schwarz no partial sum passes the product of the norms
    norm = lambda m: float(np.sqrt(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)).max(initial=0)))
    with np.errstate(over="ignore", invalid="ignore"):
        most = norm(a) * norm(b) * 1.0001
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return exact(a) @ exact(b).T if d else np.zeros((len(a), len(b)), np.int64)


def bounds(a: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with anything inside each zone, by interval arithmetic."""
    d = max(a.shape[1], lows.shape[1])
    a, lows, highs = (np.pad(m.astype(np.float64), ((0, 0), (0, d - m.shape[1]))) for m in (a, lows, highs))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ lows.T + down @ highs.T, up @ highs.T + down @ lows.T
        room = 1e-9 * (np.abs(a) @ np.maximum(np.abs(lows), np.abs(highs)).T) + 1  # rounding
        least, most = least - room, most + room
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


class Best:
    """The best ``k`` rows of many windows, by score (falling), then id."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.window, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(windows, -np.inf)  # a row below it cannot enter
        self.full = np.zeros(windows, bool)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        window, score, ids = np.concatenate([self.window, window]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort([ids, -score, window]) if score.dtype != object else np.array(
            sorted(range(len(ids)), key=lambda i: (window[i], -score[i], ids[i])), np.int64)
        window, score, ids = window[order], score[order], ids[order]
        first = np.searchsorted(window, window)
        keep = np.arange(len(window)) - first < self.k
        self.window, self.score, self.id = window[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.diff(np.concatenate([self.window, [-1]])) != 0)
        counts = np.diff(np.concatenate([[-1], last]))
        done = last[counts == self.k]
        self.floor[self.window[done]] = np.nextafter(self.score[done].astype(np.float64), -np.inf)
        self.full[self.window[done]] = True

    def of(self, window: int) -> slice:
        return slice(*np.searchsorted(self.window, [window, window + 1]))


def _likely(score: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Of the scores ``inside``, those that can be among the ``k`` best of their row."""
    if score.dtype == object or score.shape[1] <= k:
        return inside
    masked = np.where(inside, score, np.iinfo(np.int64).min)
    kth = np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return inside & (score >= kth[:, None])


def _panels(blocks: Blocks, places: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for ids, vectors in blocks.rows(places):
        held.append((ids, vectors))
        n += len(ids)
        if n >= PANEL_ROWS:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    d = max(v.shape[1] for _, v in held)
    return np.concatenate([i for i, _ in held]), np.concatenate([np.pad(v, ((0, 0), (0, d - v.shape[1]))) for _, v in held])


def _search(blocks: Blocks, anchors: np.ndarray, want, add) -> None:
    """Read the blocks that ``want`` chooses by their bounds, best first, until none is left.

    One number per file is kept to order the files; zone maps pass by a row group at a time.
    """
    files = []
    for path in blocks.paths:
        best = -np.inf
        for _, labels, lows, highs in blocks.zones(path):
            least, most = bounds(anchors, lows, highs)
            best = max(best, most[:, want(labels, least, most)].max(initial=-np.inf))
        if best > -np.inf:
            files.append((best, path))
    at_once = max(1, PANEL_ROWS // BLOCK)
    for _, path in sorted(files, reverse=True):
        for places, labels, lows, highs in blocks.zones(path):
            least, most = bounds(anchors, lows, highs)
            left = np.arange(len(places))
            while len(left):
                left = left[want(labels[left], least[:, left], most[:, left])]
                left = left[np.argsort(-most[:, left].max(0, initial=-np.inf), kind="stable")]
                now, left = left[:at_once], left[at_once:]
                by_label: dict = {}
                for b in now:
                    by_label.setdefault(labels[b], []).append(places[b])
                for label, some in by_label.items():
                    for ids, vectors in _panels(blocks, some):
                        add(label, ids, products(anchors, vectors))


def _answer(blocks: Blocks, anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, positives: int, negatives: int, low: int, high: int):
    """Rows (anchor row, positive, rank, negative, their scores) of some anchors."""
    m = len(anchors)
    found = Best(m, positives)

    def nearer(labels, least, most):
        return ((anchor_labels[:, None] == labels[None, :]) & (most >= found.floor[:, None])).any(0)

    def add_positive(label, ids, score):
        inside = (anchor_labels[:, None] == label) & (anchor_ids[:, None] != ids[None, :]) & (score >= found.floor[:, None])
        row, column = np.nonzero(_likely(score, inside.astype(bool), positives))
        found.add(row, score[row, column], ids[column])

    _search(blocks, anchors, nearer, add_positive)

    owner, n_windows = found.window, len(found.window)
    floor_of = [-(-low * int(s) // 100) for s in found.score]
    top_of = [high * int(s) // 100 for s in found.score]
    kind = object if found.score.dtype == object else np.int64
    bottom, top = np.array(floor_of, kind), np.array(top_of, kind)
    wanted = Best(n_windows, negatives)
    open_windows = np.flatnonzero(bottom <= top)

    def reaches(labels, least, most):
        need = np.maximum(bottom.astype(np.float64) * (1 - 1e-12), wanted.floor)[open_windows]
        of = owner[open_windows]
        other = anchor_labels[of][:, None] != labels[None, :]
        return (other & (most[of] >= need[:, None] - 1) & (least[of] <= top[open_windows].astype(np.float64)[:, None] * (1 + 1e-12) + 1)).any(0)

    def add_negative(label, ids, score):
        of = open_windows[anchor_labels[owner[open_windows]] != label]
        for some in np.array_split(of, max(1, len(of) // 256)):
            if not len(some):
                continue
            mine = score[owner[some]]
            inside = (mine >= bottom[some][:, None]) & (mine <= top[some][:, None]) & (mine >= wanted.floor[some][:, None])
            inside &= anchor_ids[owner[some]][:, None] != ids[None, :]
            row, column = np.nonzero(_likely(mine, inside.astype(bool), negatives))
            wanted.add(some[row], mine[row, column], ids[column])

    if len(open_windows):
        _search(blocks, anchors, reaches, add_negative)
    for w in range(n_windows):
        span = wanted.of(w)
        for rank, (negative, score) in enumerate(zip(wanted.id[span], wanted.score[span]), start=1):
            yield anchor_ids[owner[w]], found.id[w], rank, negative, found.score[w], score


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _told(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def mine(
    vectors: DataFrame, anchors: Callable[[Column], Column], new_label: Callable[[Column, Column], Column] | None = None, vector: str = "embedding", label: str = "label", key: str = "vec_id",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    ``anchors`` is a condition on the id; ``new_label`` gives the label that replaces an
    id's own. An anchor's positives are its first
    ``positives`` other rows of its label by score, then id. For each of them the first
    ``negatives`` rows of other labels follow whose score is ``low`` to ``high``
    hundredths of the positive's, ranked from 1. Zone maps only decide which blocks are
    read; every row that could enter is compared.
    """
    whole = _whole(vectors, scale, vector, label, key, new_label)
    folder = write_blocks(whole, block)
    asked = _whole(vectors.filter(anchors(vectors[key].cast("long"))), scale, vector, label, key, new_label)
    asked = asked.repartitionByRange(vectors.sparkSession.sparkContext.defaultParallelism, "label", "curve", "id").sortWithinPartitions("label", "curve", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS_AT_ONCE):
                some = batch.slice(at, ANCHORS_AT_ONCE)
                ids = some.column("id").to_numpy()
                labels = np.array(some.column("label").to_pylist(), object)
                rows = _matrix([np.frombuffer(v, np.float64) for v in some.column("v").to_pylist()])
                out = list(_answer(blocks, ids, labels, rows, positives, negatives, low, high))
                columns = list(zip(*out)) or [()] * 6
                arrays = [pa.array([int(x) for x in c], pa.int64()) for c in columns[:4]]
                arrays[2] = arrays[2].cast(pa.int32())
                arrays += [pa.array([_told(x) for x in c], pa.int64()) for c in columns[4:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return asked.mapInArrow(run, RESULT)
