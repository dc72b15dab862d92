"""Language-model scores from a weighted backoff automaton.

Word n-grams with absolute discounting, interpolated down to single words; the
discounted mass of the single words is that of the unknown word. The n-grams become
states and arcs: a state is a history, an arc on a word holds the smoothed log
probability and leads to the longest history that is a state, and where a state has
no arc, its failure arc leads to the shorter history and holds the backoff weight.
A text is scored in one walk from left to right that carries the state.

All pairs and triples of the training part count, those seen once too. A log
probability is that of the single word, plus what each longer n-gram adds over the
next shorter one: the arc's gain if the n-gram was seen, else the failure weight of its
history. ``Automaton`` holds the arcs between the ``PAIRS`` (triples: ``TRIPLES``) most
frequent words and walks the texts; all other states lie in buckets.

A place of a text is a word with the two before it. Every place goes to the bucket of
its middle word, packed to a few bytes, in files that each hold all buckets one after
another; no n-gram is ever a row. So a bucket has all n-grams that start or end with
its words, and with them their counts, histories and failure weights. Buckets are read
twice: for what the discounts and the automaton need, then for the gains, which leave
as one sum per text. Places of a word that fills more than half a bucket are dealt by
the word before it; only the pairs of such words are added up across buckets.

Words lie between ASCII white space, A-Z are lowered; every text ends with an end
token. Null and empty texts are the end token alone. One result per row, repeated
ids included. Words are compared as 64-bit hashes. Without training rows every token
is unknown with probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.llm import shared_files
from tradeq.llm.common import ODD, frequent_bound, hashes, lower_words, mix, row_ids, signed, slices, texts
from tradeq.session import settle, shared_dir

#: Words between which arcs of pairs and of triples lie in the automaton; all others lie in buckets.
PAIRS, TRIPLES = 1024, 64
#: Words whose counts are at hand: at most this many.
FREQUENT = 1 << 18
#: Places of the training part in a bucket, on average.
PLACES = 1 << 20
#: Places of a bucket that are handled at once, and bytes of packed places that a task holds.
AT_ONCE, PACKED = 3 << 19, 64 << 20
#: A word with more places than so many buckets is dealt over several.
HOT = 4
#: Neighbouring buckets that one task reads, and sums of texts that it holds before it hands them on.
NEIGHBOURS, SUMS = 16, 1 << 22
#: Distinct words that a counting task holds before it hands them on.
HELD = 1 << 20
END = hashes([b"\n"])[0]
#: What stands before the first word of a text: its hash, its number as a history.
START, BEGIN = hashes([b"\n\n"])[0], PAIRS


def tokens(text: str) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    return np.append(hashes(lower_words(text)), END)


def looked_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of ``h`` in sorted ``keys``; sorted first, as a search in order costs a fraction."""
    if len(keys) == 0:
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    if (h[1:] < h[:-1]).any():
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.searchsorted(keys, h[order])
    else:
        at = np.searchsorted(keys, h)
    np.minimum(at, len(keys) - 1, out=at)
    return at, keys[at] == h


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_words(train: DataFrame) -> DataFrame:
    """(h, n): count of every token of the texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def out():
            keys, n = _counted(held)
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], names=["h", "n"])

        for batch in slices(batches, "t"):
            h = np.concatenate([tokens(t) for t in texts(batch, "t")])
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return train.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Counts of the frequent words, their ranks, their short-list numbers (-1: none) and what all counts add up to."""

    h: np.ndarray
    n: np.ndarray
    rank: np.ndarray
    number: np.ndarray
    total: int
    distinct: int
    discount: float
    least: int  # count from which words are among the frequent ones

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known): where tokens stand among the frequent words."""
        return looked_up(self.h, h)

    @property
    def unknown(self) -> float:
        """Probability of the unknown word."""
        return self.discount * self.distinct / self.total if self.total else 1.0

    def single(self, n: np.ndarray) -> np.ndarray:
        """Probability of words by their counts."""
        return (n - self.discount) / max(1, self.total)

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts by code: the rank, then the beginning, no word, and any rare word."""
        h, n = np.zeros(len(self.h) + 3, np.uint64), np.zeros(len(self.h) + 3, np.int64)
        h[self.rank], n[self.rank] = self.h, self.n
        h[len(self.h)] = START
        n[len(self.h)] = self.n[self.h == END].sum()
        return h, n


def learn_words(counts: DataFrame, frequent: int) -> Words:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    few = {r["n"]: r["count"] for r in counts.filter("n <= 2").groupBy("n").count().collect()}
    once, twice = few.get(1, 0), few.get(2, 0)
    discount = discount_of(once, twice)
    least = frequent_bound(counts, "n", frequent)
    pulled = counts.filter(F.col("n") >= least).toArrow().to_pandas()
    h, n = pulled["h"].to_numpy(np.int64).view(np.uint64), pulled["n"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, -n))] = np.arange(len(h))
    number = np.where(rank < PAIRS, rank, -1)
    return Words(h, n, rank, number, int(total[0] or 0), int(total[1] or 0), discount, least)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their history and of the next shorter n-gram."""
    return mix(a * ODD + mix(b))


# ---- places of texts, packed by bucket ------------------------------------------


def _planes(x: np.ndarray) -> list[bytes]:
    """32-bit numbers as four packed rows of bytes, lowest first."""
    by_byte = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return [pa.compress(np.ascontiguousarray(row).tobytes(), codec="zstd", asbytes=True) for row in by_byte]


def _unplaned(parts: list[memoryview], n: int) -> np.ndarray:
    rows = [np.frombuffer(pa.decompress(p, decompressed_size=n, codec="zstd"), np.uint8) for p in parts]
    return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").reshape(-1)


def pack(codes: np.ndarray, rare: np.ndarray, row: np.ndarray, train: np.ndarray, first: int) -> bytes:
    """Places of some texts: codes of middle, first and last words one after another, hashes of the rare ones, rows from ``first`` on."""
    n = len(row)
    parts = [*_planes(codes), *_planes(np.diff(row, prepend=0)), np.packbits(train).tobytes()]
    head = np.array([n, len(rare), first, *map(len, parts)], np.int64)
    return b"".join([head.tobytes(), *parts, rare.tobytes()])


def unpack(data: bytes) -> Iterator[tuple]:
    """(codes, rare, row, train) of all that was packed, one after another."""
    at, view = 0, memoryview(data)
    while at < len(view):
        n, n_rare, first, *sizes = np.frombuffer(view, np.int64, 12, at).tolist()
        ends = np.cumsum([at + 96, *sizes]).tolist()
        parts = [view[a:b] for a, b in zip(ends, ends[1:])]
        rare = np.frombuffer(view, np.uint8, 8 * n_rare, ends[-1]).view(np.uint64)
        row = first + np.cumsum(_unplaned(parts[4:8], n).astype(np.int64))
        yield _unplaned(parts[:4], 3 * n), rare, row, np.unpackbits(np.frombuffer(parts[8], np.uint8), count=n).astype(bool)
        at = ends[-1] + 8 * n_rare


class Packer:
    """Deals places to buckets and writes them into files, each of them all buckets one after another."""

    def __init__(self, words: Words, n_buckets: int, most: int, folder: str):
        self.words, self.n_buckets, self.folder = words, n_buckets, folder
        _, n = words.coded()
        self.parts = np.maximum(1, -(-n // most)).astype(np.uint64)
        self.held: list[list[bytes]] = [[] for _ in range(n_buckets)]
        self.size = self.written = 0

    def add(self, h: np.ndarray, codes: np.ndarray, lengths: np.ndarray, train: np.ndarray, first: int) -> None:
        """The places of texts whose tokens are ``h``."""
        begins = np.cumsum(lengths) - lengths

        def shifted(x, at_start):
            out = np.empty_like(x)
            out[1:], out[begins] = x[:-1], at_start
            return out

        n = len(self.words.h)
        v, cv = shifted(h, START), shifted(codes, n)
        u, cu = shifted(v, 0), shifted(cv, n + 1)
        share = mix(np.where(cu == n + 1, h, u)) % self.parts[cv]
        bucket = (mix(v + share * ODD) % np.uint64(self.n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        row = np.repeat(np.arange(len(lengths)), lengths)
        met, at = np.unique(bucket[order], return_index=True)
        for b, lo, hi in zip(met.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            o = order[lo:hi]
            c, x = np.concatenate([cv[o], cu[o], codes[o]]), np.concatenate([v[o], u[o], h[o]])
            self.held[b].append(pack(c, x[c == n + 2], row[o], train[row[o]], first))
            self.size += len(self.held[b][-1])
        if self.size > PACKED:
            self.write()

    def write(self) -> None:
        if not self.size:
            return
        sizes = [sum(map(len, blobs)) for blobs in self.held]
        ends = 8 * (self.n_buckets + 1) + np.cumsum([0, *sizes], dtype=np.int64)
        context = TaskContext.get()
        name = f"{self.folder}/{context.partitionId() if context else 0:08d}-{self.written:06d}.places"
        shared_files.write_whole(name, b"".join([ends.tobytes(), *[blob for blobs in self.held for blob in blobs]]))
        self.held = [[] for _ in range(self.n_buckets)]
        self.size, self.written = 0, self.written + 1


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, where each is found, which of them each value is)."""
    order = np.argsort(h)
    keys = h[order]
    new = np.ones(len(h), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[new], order[new], which


@dataclass
class Places:
    """Some places of a bucket, and their distinct pairs and triples."""

    row: np.ndarray
    train: np.ndarray
    rare: np.ndarray  # places with a rare last word
    v: np.ndarray  # hashes of the pairs' words and their codes
    w: np.ndarray
    cv: np.ndarray
    cw: np.ndarray
    pair: tuple  # of all places: see ``grouped``
    history: np.ndarray  # of the distinct triples, with the pair they end with, the last code, and whether the history is a state
    ends: np.ndarray
    last: np.ndarray
    state: np.ndarray
    triple: tuple
    long: np.ndarray  # places with a triple


class Bucket:
    """All places of a bucket, read from the files of ``folder``."""

    def __init__(self, folder: str, number: int, words: Words, hot: np.ndarray):
        self.folder, self.number, self.words, self.hot = folder, number, words, hot
        self.table, _ = words.coded()
        self.kept: Places | None = None

    def groups(self) -> Iterator[Places]:
        if self.kept is not None:
            yield self.kept
            return
        system, _ = shared_files.place(self.folder)
        held, size, n_groups = [], 0, 0
        for path in shared_files.files(self.folder, ".places"):
            with system.open_input_file(path) as f:
                lo, hi = np.frombuffer(f.read_at(16, 8 * self.number), np.int64).tolist()
                data = f.read_at(hi - lo, lo)
            for part in unpack(data):
                held.append(part)
                size += len(part[2])
                if size > AT_ONCE:
                    yield self._places(held)
                    held, size, n_groups = [], 0, n_groups + 1
        if held:
            last = self._places(held)
            if n_groups == 0:
                self.kept = last
            yield last

    def _places(self, held: list) -> Places:
        n = len(self.words.h)
        sizes = np.cumsum([0, *[len(x[2]) for x in held]])
        codes, words = np.empty((3, sizes[-1]), np.uint32), np.empty((3, sizes[-1]), np.uint64)
        for lo, hi, (c, rare, *_) in zip(sizes, sizes[1:], held):
            x = self.table[c]
            x[c == n + 2] = rare
            codes[:, lo:hi], words[:, lo:hi] = c.reshape(3, -1), x.reshape(3, -1)
        (cv, cu, cw), (v, u, w) = codes, words
        row, train = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        pair = joint(v, w)
        long = np.flatnonzero(cu != n + 1)
        history = joint(u[long], v[long])
        triple = grouped(joint(history, pair[long]))
        at = triple[1]
        there = long[at]
        top = min(n, TRIPLES)
        state = (cu[there] < top) & (cv[there] < top)
        pairs = grouped(pair)
        first = pairs[1]
        return Places(
            row, train, np.flatnonzero(cw == n + 2), v[first], w[first], cv[first], cw[first], pairs,
            history[at], pair[there], cw[there], state, triple, long,
        )

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, self.hot) if len(self.hot) else np.zeros(len(v), bool)

    def count(self) -> tuple[tuple, tuple]:
        """Pairs and triples of the training part: hash, history, shorter n-gram, where the automaton knows them, count.

        Of pairs, 1 says that the automaton has the arc, 2 that it has the state as well;
        of triples, 1 that it has the arc. Pairs of hot words are all there, also those not seen.
        """
        held: list[list] = [[], []]
        size, n = 0, len(self.words.h)
        listed, top = min(n, PAIRS), min(n, TRIPLES)

        def shrunk(parts):
            if len(parts) == 1:
                return parts[0]
            h, a, b, s, times = (np.concatenate(c) for c in zip(*parts))
            keys, first, which = grouped(h)
            return keys, a[first], b[first], s[first], np.bincount(which, times).astype(np.int64)

        for g in self.groups():
            seen = g.train
            times = np.bincount(g.pair[2], seen, len(g.pair[0])).astype(np.int64)
            s = ((g.cv < listed) | (g.cv == n)) & (g.cw < listed)
            s = s.astype(np.int64) + ((g.cv < top) & (g.cw < top))
            keep = (times > 0) | self.is_hot(g.v)
            held[0].append(tuple(x[keep] for x in (g.pair[0], g.v, g.w, s, times)))
            times = np.bincount(g.triple[2], seen[g.long], len(g.triple[0])).astype(np.int64)
            keep = times > 0
            s = (g.state & (g.last < top)).astype(np.int64)
            held[1].append(tuple(x[keep] for x in (g.triple[0], g.history, g.ends, s, times)))
            size += len(held[0][-1][0]) + len(held[1][-1][0])
            if size > AT_ONCE and len(held[0]) > 1:
                held = [[shrunk(parts)] for parts in held]
                size = 0
        none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
        pairs, triples = (shrunk(parts) if parts else none for parts in held)
        return pairs, triples


def met_after(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(histories, how often they are gone on from, with how many words, which of them each of ``a`` is)."""
    keys, _, which = grouped(a)
    return keys, np.bincount(which, n, len(keys)).astype(np.int64), np.bincount(which, n > 0, len(keys)).astype(np.int64), which


@dataclass
class Layout:
    """Where places lie: the folder, the number of buckets, and the words dealt over several of them."""

    folder: str
    n_buckets: int
    hot: np.ndarray

    def buckets(self, spark) -> DataFrame:
        """(bucket): one row and one task each."""
        return spark.range(0, self.n_buckets, 1, self.n_buckets).select(F.col("id").alias("bucket"))

    def tasks(self, spark) -> int:
        """Tasks that read neighbouring buckets: few, as each has a sum for most texts, but enough for all cores."""
        return min(self.n_buckets, max(2 * spark.sparkContext.defaultParallelism, -(-self.n_buckets // NEIGHBOURS)))


def lay_places(spark, words: Words, places: int) -> tuple[Layout, int]:
    """Room for buckets of about ``places`` training places, and how many places of a word share a bucket."""
    most = max(1, int(HOT * places))
    table, n = words.coded()
    folder = shared_files.make_folder(shared_dir(spark, "lm-places"))
    return Layout(folder, max(1, -(-words.total // places)), np.sort(table[n > most])), most


GRAMS = "array<struct<h: bigint, order: int, a: bigint, b: bigint, s: int, n: bigint>>"
TOLD = f"bucket long, few array<long>, grams {GRAMS}, histories array<struct<h: bigint, order: int, total: bigint, k: bigint>>, " \
    "rare array<long>, pairs array<struct<h: bigint, v: bigint, n: bigint>>"


def _structs(kind: dict, columns: list[np.ndarray]) -> pa.Array:
    arrays = [pa.array(signed(c) if c.dtype == np.uint64 else c, t) for c, t in zip(columns, kind.values())]
    inner = pa.StructArray.from_arrays(arrays, names=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def count_buckets(frame: DataFrame, layout: Layout, words, every: bool = False) -> DataFrame:
    """What each bucket tells of its counts (``TOLD``): how many n-grams of each order were seen once and twice; n-grams that the
    automaton has (or every one) and its histories; rare last words, and pairs of hot words."""
    long, small = pa.int64(), pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        listed, top = known.h[known.number >= 0], known.h[known.rank < TRIPLES]
        states = np.sort(joint(np.repeat(top, len(top)), np.tile(top, len(top))))
        for number in [b for batch in batches for b in batch.column("bucket").to_pylist()]:
            bucket = Bucket(layout.folder, number, known, layout.hot)
            pairs, triples = bucket.count()
            hot = bucket.is_hot(pairs[1])
            few = [int((n == times).sum()) for n in (pairs[4][~hot], triples[4]) for times in (1, 2)]
            grams, histories = [], []
            for order, (h, a, b, s, n) in enumerate((pairs, triples), 2):
                keep = (n > 0) & ((s > 0) | every)
                grams.append([h[keep], np.full(keep.sum(), order), a[keep], b[keep], s[keep], n[keep]])
            keep = ~hot & (looked_up(listed, pairs[1])[1] | (pairs[1] == START))
            histories.append((2, met_after(pairs[1][keep], pairs[4][keep])))
            keep = looked_up(states, triples[1])[1]
            histories.append((3, met_after(triples[1][keep], triples[4][keep])))
            rare = [g.w[g.cw == len(known.h) + 2] for g in bucket.groups()]
            rare = np.unique(np.concatenate(rare)) if rare else np.empty(0, np.uint64)
            columns = [
                pa.array([number], long), pa.array([few], pa.list_(long)),
                _structs({"h": long, "order": small, "a": long, "b": long, "s": small, "n": long}, [np.concatenate(c) for c in zip(*grams)]),
                _structs(
                    {"h": long, "order": small, "total": long, "k": long},
                    [np.concatenate(c) for c in zip(*[(h, np.full(len(h), o), n, k) for o, (h, n, k, _) in histories])],
                ),
                pa.array([signed(rare)], pa.list_(long)),
                _structs({"h": long, "v": long, "n": long}, [pairs[0][hot], pairs[1][hot], pairs[4][hot]]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "few", "grams", "histories", "rare", "pairs"])

    return layout.buckets(frame.sparkSession).mapInArrow(run, TOLD)


def _added_up(told: DataFrame) -> DataFrame:
    """(h, order, a, b, s, n) of the n-grams that buckets tell; pairs of hot words come from several."""
    rows = told.select(F.inline("grams"))
    return rows.groupBy("h").agg(*[F.min(c).alias(c) for c in ("order", "a", "b", "s")], F.sum("n").alias("n"))


def count_grams(train: DataFrame, words, places: int = PLACES) -> DataFrame:
    """(h, order, a, b, s, n): count of every pair and triple of the texts ``t``, with history, shorter n-gram and place in the automaton."""
    layout, most = lay_places(train.sparkSession, words.value, places)
    rows = train.select(F.lit(None).cast("long").alias("k"), "t", F.lit(True).alias("train"))
    settle(read_texts(rows, words, layout, most), "texts")
    return _added_up(count_buckets(train, layout, words, every=True))


def read_texts(rows: DataFrame, words, layout: Layout, most: int) -> DataFrame:
    """Writes the places of the texts ``t``, and gives (row, k, n, known, base, own, numbers) of each.

    ``known``, ``base`` and ``own`` are of its frequent words, ``own`` without those on the short list;
    ``numbers`` are those of the short list, with -1 for what lies between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        packer, ids, n = Packer(known, layout.n_buckets, most, layout.folder), row_ids(), len(known.h)
        _, count = known.coded()
        n_all = known.total + 0.5 * (known.distinct + 1)
        base = np.log10((count[:n] + 0.5) / n_all)
        own = np.log10(known.single(count[:n]))
        own[: min(n, PAIRS)] = 0.0
        base, own = (np.concatenate([x, np.zeros(3)]) for x in (base, own))
        for batch in slices(batches, "t"):
            each = [tokens(t) for t in texts(batch, "t")]
            h, lengths = np.concatenate(each), np.array([len(x) for x in each])
            at, found = known.find(h)
            codes = np.full(len(h), n + 2, np.int64)
            codes[found] = known.rank[at[found]]
            rows = [next(ids) for _ in each]
            train = np.array(batch.column("train").to_pylist(), bool)
            packer.add(h, codes.astype(np.uint32), lengths, train, rows[0])
            begins = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, begins) for x in (found.astype(np.int64), base[codes], own[codes])]
            numbers = np.where(found & (codes < PAIRS), codes, -1).astype(np.int16)
            # a second word in a row that is not on the short list changes no state
            keep = numbers >= 0
            keep[1:] |= numbers[:-1] >= 0
            keep[begins] = True
            short = np.add.reduceat(keep.astype(np.int64), begins)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(short)]), pa.int32()), pa.array(numbers[keep], pa.int16()))
            columns = [pa.array(rows, pa.int64()), batch.column("k"), pa.array(lengths, pa.int64()), *map(pa.array, sums), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "n", "known", "base", "own", "numbers"])
        packer.write()

    kind = rows.schema["k"].dataType.simpleString()
    fields = f"row long, k {kind}, n long, known long, base double, own double, numbers array<short>"
    return rows.mapInArrow(run, fields)


def discount_of(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


@dataclass
class Automaton:
    """``arcs``: state * PAIRS + word to log10 probability; per state its failure state and the weight of failing."""

    arcs: dict[int, float]
    fail: list[int]
    weight: list[float]

    def walk(self, numbers: list[int]) -> float:
        """Log10 probability of the short-listed tokens, and of leaving to the single words before all others."""
        arcs, fail, weight = self.arcs, self.fail, self.weight
        state, before, total = BEGIN + 1, PAIRS, 0.0
        for v in numbers:
            if v < 0:
                while state:
                    total += weight[state]
                    state = fail[state]
                before = PAIRS
                continue
            w = arcs.get(state * PAIRS + v)
            while w is None:
                total += weight[state]
                state = fail[state]
                w = arcs.get(state * PAIRS + v)
            total += w
            state = PAIRS + 2 + before * TRIPLES + v if before < TRIPLES and v < TRIPLES else v + 1
            before = v
        return total


def build(words: Words, grams, discounts: dict | None = None, backoffs: dict | None = None) -> Automaton:
    """The automaton of the short list; states: 0 none, 1.. one word, then the beginning, then two words.

    ``grams`` holds at least the n-grams between listed words. Discounts by order, and the
    (total, backoff weight) of histories by hash, come from all n-grams; without them ``grams`` are all.
    """
    if discounts is None:
        few = {o: (int((g["n"] == 1).sum()), int((g["n"] == 2).sum())) for o, g in grams.groupby("order")}
        discounts = {o: discount_of(*few.get(o, (0, 0))) for o in (2, 3)}
        met = grams.groupby(["order", "a"])["n"].agg(["sum", "count"])
        backoffs = {a: (n, discounts[o] * k / n) for (o, a), n, k in zip(met.index, met["sum"], met["count"])}
    listed = np.flatnonzero(words.number >= 0)
    single, name = np.zeros(PAIRS), np.zeros(PAIRS + 1, np.uint64)
    single[words.number[listed]] = words.single(words.n[listed])
    name[words.number[listed]], name[BEGIN] = words.h[listed], START
    n_states = PAIRS + 2 + TRIPLES * TRIPLES
    fail, backoff, totals = np.zeros(n_states, np.int64), np.ones(n_states), np.ones(n_states)
    # two-word histories fail to their second word
    fail[PAIRS + 2 :] = np.tile(np.arange(TRIPLES), TRIPLES) + 1
    top = np.arange(min(TRIPLES, len(listed)))
    u, v = np.repeat(top, len(top)), np.tile(top, len(top))
    one, two = np.append(np.arange(len(listed)), BEGIN) + 1, PAIRS + 2 + u * TRIPLES + v
    states = []
    for h, state in ((name[one - 1], one), (joint(name[u], name[v]), two)):
        order = np.argsort(h)
        states.append((h[order], state[order]))
        for key, at in zip(signed(h).tolist(), state.tolist()):
            totals[at], backoff[at] = backoffs.get(key, (1, 1.0))

    def known(order):
        """State, state of the next shorter n-gram, and discounted counts."""
        g = grams[(grams["order"] == order) & (grams["s"] > 0)]
        keys, of = states[order - 2]
        a, b = (of[looked_up(keys, g[c].to_numpy(np.int64).view(np.uint64))[0]] for c in "ab")
        return a, b, g["n"].to_numpy(np.float64) - discounts[order]

    state, v, n = known(2)
    v = v - 1
    p = n / totals[state] + backoff[state] * single[v]
    order = np.argsort(keys := state * PAIRS + v)
    keys, p = keys[order], p[order]
    state, v, n = known(3)
    v = (v - PAIRS - 2) % TRIPLES
    lower = p[looked_up(keys, fail[state] * PAIRS + v)[0]] if len(v) else np.empty(0)
    word = np.flatnonzero(single > 0)
    arcs: dict[int, float] = {}
    for k, q in ((word, single[word]), (state * PAIRS + v, n / totals[state] + backoff[state] * lower), (keys, p)):
        arcs.update(zip(k.tolist(), np.log10(q).tolist()))
    return Automaton(arcs, fail.tolist(), np.log10(backoff).tolist())


def pulled(column: pa.ListArray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of one list of a batch, in order of the hashes."""
    h, n = column.slice(at, 1).flatten().flatten()
    h, n = h.to_numpy().view(np.uint64), n.to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def gains(bucket: Bucket, discounts: dict, rare: tuple, hot_pairs: tuple, hot_words: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, own, base, known) of texts: what the bucket's rare words tell of them, and in ``own`` what its
    n-grams add beyond the single words and what the automaton tells."""
    words = bucket.words
    (h, a, b, _, n), (th, ta, tb, _, tn) = bucket.count()
    if (hot := bucket.is_hot(a)).any():
        at, found = looked_up(hot_pairs[0], h[hot])
        n[hot] = hot_pairs[1][at] * found if len(hot_pairs[0]) else 0
    v, total, k, place = met_after(a, n)
    at, found = looked_up(hot_words[0], v)
    total[found], k[found] = hot_words[1][at[found]], hot_words[2][at[found]]
    counts = np.zeros(len(b), np.int64)
    for keys, of in ((words.h, words.n), rare):
        at, found = looked_up(keys, b)
        counts[found] = of[at[found]]
    q = np.where(counts > 0, words.single(counts), 1.0)
    fails = discounts[2] * k / np.maximum(total, 1)
    p = np.where(n > 0, (n - discounts[2]) / np.maximum(total[place], 1) + fails[place] * q, 1.0)
    gain = np.log10(p / q)
    tv, total_3, k_3, place = met_after(ta, tn)
    fails_3 = discounts[3] * k_3 / np.maximum(total_3, 1)
    below = p[looked_up(h, tb)[0]] if len(th) else np.empty(0)
    gain_3 = np.log10(((tn - discounts[3]) / total_3[place] + fails_3[place] * below) / below)
    size = len(words.h)
    listed, top = min(size, PAIRS), min(size, TRIPLES)

    def added(keys, of, seen_n, histories, fails, totals, grams, before, told_arc, told_fail):
        """Gains of distinct n-grams: the arc's if seen, else the failure weight, less what the automaton tells."""
        at, known = looked_up(histories, before)
        fail = np.zeros(len(before))
        known[known] = totals[at[known]] > 0
        fail[known] = np.log10(fails[at[known]])
        at, seen = looked_up(keys, grams)
        seen[seen] = seen_n[at[seen]] > 0
        full = fail.copy()
        full[seen] = of[at[seen]]
        return np.where(told_fail, np.where(told_arc, 0.0, full - fail), full)

    for g in bucket.groups():
        of_pair = added(h, gain, n, v, fails, total, g.pair[0], g.v, g.cw < listed, (g.cv < listed) | (g.cv == size))
        of_triple = added(th, gain_3, tn, tv, fails_3, total_3, g.triple[0], g.history, g.last < top, g.state)
        value = of_pair[g.pair[2]]
        value[g.long] += of_triple[g.triple[2]]
        rows, _, which = grouped(g.row)
        # single words that are not at hand
        at, known = looked_up(rare[0], g.w)
        count = np.zeros(len(g.w), np.int64)
        count[known] = rare[1][at[known]]
        pair, which_rare = g.pair[2][g.rare], which[g.rare]
        value[g.rare] += np.log10(np.where(count > 0, words.single(count), words.unknown))[pair]
        base = np.log10((count + 0.5) / (words.total + 0.5 * (words.distinct + 1)))[pair]
        sums = [(which, value), (which_rare, base), (which_rare, (count > 0)[pair])]
        yield rows, *[np.bincount(at, x, len(rows)) for at, x in sums]


#: Texts whose sums travel together, as a power of two.
TOGETHER = 14


def sums_of_texts(given: DataFrame, layout: Layout, words, discounts: dict, hot_words: tuple) -> DataFrame:
    """(row, own, base, known): the sums of ``gains`` of each text; ``given`` are (bucket, rare, pairs) with the counts that buckets asked for."""
    names = ["own", "base", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def added():
            rows, _, which = grouped(np.concatenate([x[0] for x in held]))
            return rows, *[np.bincount(which, np.concatenate(x), len(rows)) for x in list(zip(*held))[1:]]

        def out():
            rows, *sums = held[0]
            kept, at = np.unique(rows >> TOGETHER, return_index=True)
            ends = [*at[1:].tolist(), len(rows)]
            inner = (rows & ((1 << TOGETHER) - 1)).astype("<u2")
            packed = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(at.tolist(), ends)], pa.binary()) for x in (inner, *sums)]
            return pa.RecordBatch.from_arrays([pa.array(kept), *packed], names=["g", "rows", *names])

        for batch in batches:
            for i, number in enumerate(batch.column("bucket").to_pylist()):
                bucket = Bucket(layout.folder, number, words.value, layout.hot)
                for found in gains(bucket, discounts, pulled(batch.column("rare"), i), pulled(batch.column("pairs"), i), hot_words):
                    held = [*held, found]
                    held = [added()]
                    if len(held[0][0]) > SUMS:
                        yield out()
                        held = []
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, rows, *values in zip(*[c.to_pylist() for c in batch.columns]):
                mine = sums.setdefault(g, np.zeros((4, 1 << TOGETHER)))
                at = np.frombuffer(rows, "<u2")
                mine[:3, at] += [np.frombuffer(x, np.float64) for x in values]
                mine[3, at] = 1
        for g, mine in sums.items():
            rows = np.flatnonzero(mine[3])
            columns = [(g << TOGETHER) + rows, mine[0, rows], mine[1, rows], mine[2, rows].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", *names])

    dealt = given.repartitionByRange(layout.tasks(given.sparkSession), "bucket")
    packed = dealt.mapInArrow(run, "g long, rows binary, own binary, base binary, known binary")
    return packed.repartition("g").mapInArrow(add, "row long, own double, base double, known long")


def ask_counts(spark, layout: Layout, told: DataFrame, counts: DataFrame) -> tuple[DataFrame, list, tuple]:
    """(given, few, hot_words): what ``sums_of_texts`` needs besides, and how many pairs of hot words were seen once and twice.

    ``given`` are, for every bucket, the counts of its rare words and of its pairs of hot words.
    """
    rare = told.select("bucket", F.explode("rare").alias("h")).join(counts, "h")
    few, hot_words = [0, 0], tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64))
    if len(layout.hot):
        asked = told.select("bucket", F.inline("pairs"))
        pairs = settle(asked.groupBy("h").agg(F.min("v").alias("v"), F.sum("n").alias("n")).filter("n > 0"), "hot-pairs")
        few = list(pairs.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())
        per_word = pairs.groupBy("v").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas()
        order = np.argsort(per_word["v"].to_numpy(np.int64).view(np.uint64))
        hot_words = tuple(per_word[c].to_numpy(np.int64)[order] for c in ("v", "n", "k"))
        hot_words = (hot_words[0].view(np.uint64), *hot_words[1:])
        met = asked.select("bucket", "h").join(pairs.select("h", "n"), "h")
        kinds = rare.select("bucket", F.lit(False).alias("hot"), "h", "n").union(met.select("bucket", F.lit(True), "h", "n"))
    else:
        kinds = rare.select("bucket", F.lit(False).alias("hot"), "h", "n")
    lists = {name: F.collect_list(F.when(F.col("hot") == hot, F.struct("h", "n"))).alias(name) for name, hot in (("rare", False), ("pairs", True))}
    per_bucket = kinds.groupBy("bucket").agg(*lists.values())
    none = F.array().cast("array<struct<h: bigint, n: bigint>>")
    given = layout.buckets(spark).join(per_bucket, "bucket", "left").select("bucket", *[F.coalesce(c, none).alias(c) for c in lists])
    return settle(given, "given-counts"), few, hot_words


def learn(told: DataFrame, words: Words, few: list, hot_words: tuple) -> tuple[Automaton, dict]:
    """The automaton, and the discounts by order."""
    seen = np.array([r["few"] for r in told.select("few").collect()]).sum(0)
    discounts = {2: discount_of(int(seen[0]) + few[0], int(seen[1]) + few[1]), 3: discount_of(int(seen[2]), int(seen[3]))}
    backoffs = {r["h"]: (r["total"], discounts[r["order"]] * r["k"] / r["total"]) for r in told.select(F.inline("histories")).toLocalIterator()}
    backoffs |= {h: (n, discounts[2] * k / n) for h, n, k in zip(signed(hot_words[0]).tolist(), *[x.tolist() for x in hot_words[1:]])}
    return build(words, _added_up(told).drop("h").toArrow().to_pandas(), discounts, backoffs), discounts


def score(
    docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT, places: int = PLACES
) -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every whole text.

    ``train`` says which rows of ``docs`` to learn from. ``base_score`` is that of single
    words with half a count added to each and to the unknown word.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = settle(count_words(rows.filter("train").select("t")), "word-counts")
    words = learn_words(counts, frequent)
    sent_words = context.broadcast(words)
    layout, most = lay_places(spark, words, places)
    read = settle(read_texts(rows, sent_words, layout, most), "texts")
    told = settle(count_buckets(docs, layout, sent_words), "told-counts")
    given, few, hot_words = ask_counts(spark, layout, told, counts)
    graph, discounts = learn(told, words, few, hot_words)
    automaton = context.broadcast(graph)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walked = [automaton.value.walk(numbers) for numbers in batch.column("numbers").to_pylist()]
            own = pa.array(batch.column("own").to_numpy() + np.array(walked))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names[:-2]] + [own], names=batch.schema.names[:-1])

    kept = ["row", "k", "n", "known", "base", "own"]
    kind = docs.schema[key].dataType.simpleString()
    walked = read.select(*kept, "numbers").mapInArrow(walk, f"row long, k {kind}, n long, known long, base double, own double")
    sums = sums_of_texts(given, layout, sent_words, discounts, hot_words)
    parts = walked.unionByName(sums, allowMissingColumns=True)
    return parts.groupBy("row").agg(
        F.first("k", ignorenulls=True).alias(key), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("own").alias("score"),
    ).select(key, "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
