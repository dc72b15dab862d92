"""Repeated passages by sparse suffix arrays.

A passage is a run of ``PASSAGE`` words or more that stands in two or more documents.
Suffixes are retained at minimiser positions of word n-grams, which any two copies of
a passage share whatever stands around it. The retained suffixes are sorted by their
leading words and neighbours compared; a suffix with an equal neighbour in another
document is extended to the left and right: the windows of ``PASSAGE`` words around
it are sorted and compared in turn, so that exactly the repeated windows are found.
Overlapping windows make spans.

Of each repeated window the document with the smallest id keeps its copy; spans of
later copies are marked ``removed``. Texts with the same words are one document while
searching; of two or more such texts all but the smallest id are removed as a whole.
Repetition inside one document is left alone.

Sorting ranges over the document as well as the words, so that the copies of a very
common passage spread over many tasks; runs over the borders of tasks are settled by
their first and last keys. Null and short texts have no passage; rows with a null id
are not searched. Words lie between ASCII white space, A-Z are lowered, and are
compared as 64-bit hashes. Rows that repeat an id with the same words are one document;
of an id that repeats with other words one text is searched, the rest left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.llm.common import ODD, SMALL, hashes, lower_words, mix, runs, signed, slices, texts
from tradeq.session import settle, settle_alone

#: Words of the shortest passage.
PASSAGE = 50
#: Words of an n-gram, and n-grams in a row of which the least is retained.
GRAM, ROW = 8, 32
#: Words that a retained suffix has to its right in every window of a passage around it.
LEADING = PASSAGE - ROW + 1

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sequence_hash(h: np.ndarray) -> int:
    """One hash for a sequence of words."""
    at = np.arange(1, len(h) + 1, dtype=np.uint64) * ODD
    total = mix(mix(h) + at).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(signed(mix(np.array([total])))[0])


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = pick(a[:-step], a[step:])
        done += step
    return a


def retained(h: np.ndarray) -> np.ndarray:
    """Positions of the least n-grams; equal least ones are all retained."""
    g = runs(h, GRAM)
    least = sliding(g, ROW, np.minimum)
    # a position is retained if the greatest minimum of the rows around it is its own value
    padded = np.concatenate([np.zeros(ROW - 1, np.uint64), least, np.zeros(ROW - 1, np.uint64)])
    return np.flatnonzero(sliding(padded, ROW, np.maximum) == g)


def suffixes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per document ``k``, ``v`` (hash of its words), ``n`` (words), and of its suffixes ``h`` (leading words) and ``p``."""
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).filter("k IS NOT NULL")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SMALL):
            v, n, keys, places = [], [], [], []
            for t in texts(batch, "t"):
                h = hashes(lower_words(t))
                v.append(sequence_hash(h))
                n.append(len(h))
                if len(h) < PASSAGE:
                    keys.append([])
                    places.append([])
                    continue
                p = retained(h)
                p = p[p <= len(h) - LEADING]
                keys.append(signed(runs(h, LEADING)[p]))
                places.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(v, pa.int64()), pa.array(n, pa.int64())]
                + [pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                names=["k", "v", "n", "h", "p"],
            )

    return rows.mapInArrow(run, f"k {kind}, v long, n long, h array<long>, p array<long>")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows (h, k, p) whose ``h`` stands in two or more ``k``, with ``lo``: ``k`` itself in the least of them, else a lesser one.

    The rows are sorted over all tasks; a task compares neighbours while rows pass. What
    it cannot tell alone, of the first document in its first run of equal ``h`` and of a
    last run of one document, is told by the border rows of all tasks: two a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h, k, p, lo, edge, border):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x, np.int64)) for x in (h, k, p, lo)] + [pa.array(np.asarray(edge, bool)), pa.array(np.asarray(border, bool))],
                names=["h", "k", "p", "lo", "edge", "border"],
            )

        waiting = [np.empty(0, np.int64)] * 3  # rows of the last run so far, of one document
        first_run = last = None  # keys
        lo = hi = None  # of the last run so far
        open_run = False  # whether the last run has two documents already
        edges = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h, k, p = (np.concatenate([w, np.asarray(batch.column(c))]) for w, c in zip(waiting, ("h", "k", "p")))
            if first_run is None:
                first_run = h[0]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            end = np.append(start[1:], len(h))
            low, high = k[start].copy(), k[end - 1].copy()
            several = low != high
            if last is not None and h[0] == last:
                low[0] = lo
                several[0] |= open_run or lo != high[0]
            run_of = np.repeat(np.arange(len(start)), end - start)
            last, lo, hi, open_run = h[-1], low[-1], high[-1], bool(several[-1])
            if h[0] == first_run:
                edges[first_run] = (low[0], high[0])
            keep = several[run_of] | ((h == first_run) & (h != last))
            if open_run:
                waiting = [np.empty(0, np.int64)] * 3
            else:
                waiting = [x[start[-1] :] for x in (h, k, p)]
                keep[start[-1] :] = False
            if keep.any():
                n = int(keep.sum())
                low = low[run_of][keep]
                yield out(h[keep], k[keep], p[keep], low, (h[keep] == first_run) & (k[keep] == low), np.zeros(n, bool))
        if last is None:
            return
        edges[last] = (edges[last][0] if last in edges else lo, hi)
        if len(waiting[0]):
            n = len(waiting[0])
            yield out(*waiting, np.full(n, lo), np.ones(n, bool), np.zeros(n, bool))
        keys = list(edges)
        n = len(keys)
        yield out(keys, [edges[x][1] for x in keys], np.zeros(n), [edges[x][0] for x in keys], np.ones(n, bool), np.ones(n, bool))

    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(partitions, "h", "k", "p").sortWithinPartitions("h", "k", "p")
    told = settle(ordered.mapInArrow(run, "h long, k long, p long, lo long, edge boolean, border boolean"), "neighbours")
    # two rows a task: small enough to send to every task
    borders = told.filter("border").groupBy("h").agg(F.min("lo").alias("least"), F.max("k").alias("most"))
    known = told.filter("NOT border AND NOT edge").select("h", "k", "p", "lo")
    edge = told.filter("NOT border AND edge").join(F.broadcast(borders), "h").filter("least <> most")
    return known.union(edge.select("h", "k", "p", F.col("least").alias("lo")))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``start_word``, ``end_word`` (exclusive), ``removed`` of every repeated span; ``v`` tells the words it was found in.

    Ids are integers.
    """
    rows = settle(suffixes(docs, text, key), "suffixes")
    same = rows.groupBy("k").agg(F.min(F.struct("v", "n")).alias("x")).select("k", "x.v", "x.n")
    nodes = same.groupBy("v").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("n").alias("n"))
    distinct = rows.select("v", F.explode(F.arrays_zip("h", "p")).alias("z")).select(
        F.col("z.h").alias("h"), F.col("v").alias("k"), F.col("z.p").alias("p")
    ).distinct()
    matched = _neighbours(settle(distinct, "suffix-array"))
    anchors = matched.select(F.col("k").alias("v"), "p").groupBy("v").agg(F.collect_list("p").alias("p"))
    anchors = anchors.join(nodes, "v").select(F.col("lo").alias("k"), "v", "p")
    windows = settle(_windows(docs, text, key, anchors), "windows")
    repeated = _neighbours(windows)
    found = repeated.select("k", (F.col("k") != F.col("lo")).alias("removed"), F.col("p").alias("s"), (F.col("p") + PASSAGE).alias("e"))
    copies = same.join(nodes.filter(f"lo <> hi AND n >= {PASSAGE}").select("v", "lo"), "v").select(
        "k", (F.col("k") != F.col("lo")).alias("removed"), F.lit(0).cast("long").alias("s"), F.col("n").alias("e"), "v"
    )
    merged = found.groupBy("k", "removed").agg(F.collect_list(F.struct("s", "e")).alias("w"))
    merged = merged.join(nodes.select(F.col("lo").alias("k"), "v"), "k")
    whole = copies.select("k", "v", "removed", F.array(F.struct("s", "e")).alias("w"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, removed, s, e = [], [], [], [], []
            for row in batch.to_pylist():
                pieces: list[list[int]] = []
                for w in sorted((w["s"], w["e"]) for w in row["w"]):
                    if pieces and w[0] <= pieces[-1][1]:
                        pieces[-1][1] = max(pieces[-1][1], w[1])
                    else:
                        pieces.append(list(w))
                for a, b in pieces:
                    k.append(row["k"])
                    v.append(row["v"])
                    removed.append(row["removed"])
                    s.append(a)
                    e.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (k, v)] + [pa.array(removed, pa.bool_())] + [pa.array(x, pa.int64()) for x in (s, e)],
                names=["k", "v", "removed", "start_word", "end_word"],
            )

    out = merged.unionByName(whole).mapInArrow(run, "k long, v long, removed boolean, start_word long, end_word long")
    return out.select(F.col("k").cast(kind).alias(key), "v", "start_word", "end_word", "removed")


def _windows(docs: DataFrame, text: str, key: str, anchors: DataFrame) -> DataFrame:
    """(h, k, p): the windows of ``PASSAGE`` words around the matched suffixes of a document."""
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).join(anchors, "k").select("k", "t", "v", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SMALL):
            h_all, k_all, p_all = [], [], []
            for k, t, v, p in zip(
                batch.column("k").to_pylist(), texts(batch, "t"), batch.column("v").to_pylist(), batch.column("p").to_pylist()
            ):
                h = hashes(lower_words(t))
                if sequence_hash(h) != v:
                    continue  # the id repeats with other words
                starts = np.zeros(len(h) + 1, np.int64)
                for shift in range(ROW):
                    at = np.array(p) - shift
                    starts[at[at >= 0]] = 1
                at = np.flatnonzero(starts[: len(h) - PASSAGE + 1])
                h_all.append(runs(h, PASSAGE)[at])
                p_all.append(at)
                k_all.append(np.full(len(at), k, np.int64))
            if h_all:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(h_all)))] + [pa.array(np.concatenate(x)) for x in (k_all, p_all)],
                    names=["h", "k", "p"],
                )

    return rows.mapInArrow(run, "h long, k long, p long")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans and the white space after each."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(data[at : starts[a]])
        at = starts[b]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = None) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``; every row stays, all other columns as they are.

    ``length`` names a column that holds the number of characters and is set anew where a text changes.
    Only the spans are written for good; the tables on the way to them are dropped.
    """
    def cuts() -> DataFrame:
        removed = spans(docs, text, key).filter("removed").groupBy(F.col(key).alias("__k"))
        return removed.agg(F.min("v").alias("__v"), F.collect_list(F.struct("start_word", "end_word")).alias("__w"))

    gone = settle_alone(docs.sparkSession, cuts, "cuts")
    names = docs.columns
    joined = docs.join(gone, docs[key] == gone["__k"], "left").drop("__k")
    plain = joined.toDF(*[f"c{i}" for i in range(len(names))], "v", "w")
    at = names.index(text)
    rest = [f"c{i}" for i in range(len(names))]
    schema = plain.select(*rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", SMALL):
            out = batch.column(f"c{at}").to_pylist()
            sizes = batch.column(f"c{names.index(length)}").to_pylist() if length else None
            for i, (v, w) in enumerate(zip(batch.column("v").to_pylist(), batch.column("w").to_pylist())):
                if w and out[i] and sequence_hash(hashes(lower_words(out[i]))) == v:
                    out[i] = cut(out[i], [(x["start_word"], x["end_word"]) for x in w])
                    if length:
                        sizes[i] = len(out[i])
            columns = [batch.column(c) for c in rest]
            columns[at] = pa.array(out, columns[at].type)
            if length:
                columns[names.index(length)] = pa.array(sizes, columns[names.index(length)].type)
            yield pa.RecordBatch.from_arrays(columns, names=rest)

    return plain.mapInArrow(run, schema).toDF(*names)
