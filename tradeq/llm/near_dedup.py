"""Near-duplicate groups by SetSketch registers.

A document is the set of its distinct 5-word shingles. Its sketch has registers with
exponentially spaced values of truncated minima: mergeable (register-wise maximum)
and locality sensitive. Bands of registers give buckets; the members of a bucket are
compared with few hubs of it instead of with each other, and members that another
comparison has joined are not compared again. The Jaccard similarity of a pair is
estimated jointly from both sketches by likelihood; pairs that can be linked at all
are verified on their full sets. Links make components.

Equal sets are one node from the start, so copies cost one row each. A bucket is done
when its members are all in one component or every member outside its main component
has been compared with all others. Members of buckets that stay crowded (similar texts
below the threshold) are compared in blocks: a task holds two blocks of bounded size,
counts all intersections at once and returns links only. No cap, and no pairs of a
whole group are made as rows; the work in a crowd is quadratic in its size, spread
over its blocks. Bands and all first looks follow the threshold; a link is missed only
if no band agrees: below one in a million at the threshold, less above.

Texts without words, and null texts, have an empty set and are linked with nothing.
Null ids are linked with nothing. Rows that repeat an id are handled row by row.
Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.llm.common import SMALL, hashes, lower_words, mix, runs, signed, slices, texts
from tradeq.session import settle, settle_alone

WORDS = 5
#: Link at 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Registers of a sketch; a pair at the threshold misses all bands with less than this chance.
REGISTERS, MISS = 252, 1e-8
#: Base of the register values, rate of the exponential, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: A pair is dropped unverified if its sketches are less likely than this factor (log) at the threshold.
UNLIKELY = 15.0
#: Bands of the first round; members outside the main component with which a bucket is no longer crowded;
#: sets in a block of a crowd, and shingles counted at once.
FIRST_BANDS, FEW, BLOCK, SHINGLES = 4, 16, 512, 4096
#: Registers whose low bytes ride along with bucket members; deviations below the mean down to which they must agree.
RIDING, DEVIATIONS = 126, 6.25
#: Low bits of a band's key that hold its number.
NUMBER = 255

_draw = np.random.Generator(np.random.PCG64(20))
MULTIPLY = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; with fewer words, of the whole sequence."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    if len(words) < WORDS:
        return runs(np.append(h, np.uint64(len(words))), len(words) + 1)
    return np.unique(runs(h, WORDS))


def set_hash(s: np.ndarray) -> int:
    """One hash for a set of shingles."""
    if len(s) == 0:
        return 0
    both = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.array([both.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(both)), np.uint64(len(s))])
    return int(signed(runs(total, 3))[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Register values of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(least, (s[a : a + 2048, None] * MULTIPLY + ADD).min(0), out=least)
    x = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def banding(threshold: int) -> tuple[int, int]:
    """Bands, and rows of a band: the longest that still find pairs at the threshold; 42 of 6 at 85, 50 of 5 at 80."""
    for rows in range(REGISTERS, 0, -1):
        if (1 - (threshold / 100) ** rows) ** (REGISTERS // rows) < MISS:
            return REGISTERS // rows, rows
    raise ValueError(f"{REGISTERS} registers cannot find pairs at {threshold} of 100")


def least_agreeing(threshold: int) -> int:
    """Riding registers that agree in any pair at the threshold: 82 at 85, 72 at 80."""
    j = threshold / 100
    return int(max(0.0, RIDING * j - DEVIATIONS * (RIDING * j * (1 - j)) ** 0.5))


def band_keys(registers: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """A key per band; its low 8 bits are the band's number."""
    n, rows = banding(threshold)
    r = registers[: n * rows].reshape(n, rows).astype(np.uint64)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, i])
    return (h & ~np.uint64(NUMBER)) | np.arange(n, dtype=np.uint64)


def log_likelihood(j: np.ndarray, u: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Log likelihood of Jaccard ``j`` given how many registers of the first set are larger or smaller.

    ``u`` is the first set's share of the sum of both sizes.
    """
    def p(x):
        return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    a, b = p(np.maximum(u - (1 - u) * j, 0)), p(np.maximum((1 - u) - u * j, 0))
    return up * np.log(a) + down * np.log(b) + (REGISTERS - up - down) * np.log(np.maximum(1 - a - b, 1e-12))


def may_link(n1: np.ndarray, n2: np.ndarray, k1: np.ndarray, k2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sets can reach the threshold, by size and by joint likelihood of their sketches."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    u = n1 / (n1 + n2)
    up, down = (k1 > k2).sum(1), (k1 < k2).sum(1)
    most = small / large
    best = np.full(len(n1), -np.inf)
    for share in np.linspace(0, 1, 101):
        best = np.maximum(best, log_likelihood(share * most, u, up, down))
    # the likeliest similarity at or above the threshold
    at = np.full(len(n1), -np.inf)
    for share in np.linspace(0, 1, 21):
        at = np.maximum(at, log_likelihood(threshold + share * np.maximum(most - threshold, 0), u, up, down))
    return (most >= threshold - 1e-12) & (at >= best - UNLIKELY)


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``k``, ``n`` (set size), ``v`` (hash of the set) and ``s`` (sketch, null for an empty set) of every row."""
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SMALL):
            sets = [shingles(t) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["k", "n", "v", "s"],
            )

    return rows.mapInArrow(run, f"k {kind}, n long, v long, s binary")


def _bands(nodes: DataFrame, threshold: int) -> DataFrame:
    """(bucket, node) of every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = [np.frombuffer(s, np.uint16) for s in batch.column("s").to_pylist()]
                keys = np.concatenate([band_keys(r, threshold) for r in registers])
                v = np.repeat(np.asarray(batch.column("v")), banding(threshold)[0])
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(v)], names=["bucket", "v"])

    return nodes.select("v", "s").mapInArrow(run, "bucket long, v long")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (v, w) whose sketches allow a link."""
    a = nodes.select("v", F.col("n").alias("n1"), F.col("s").alias("s1"))
    b = nodes.select(F.col("v").alias("w"), F.col("n").alias("n2"), F.col("s").alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                k1, k2 = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s1", "s2")
                )
                n1, n2 = (np.asarray(part.column(c)).astype(float) for c in ("n1", "n2"))
                ok = pa.array(may_link(n1, n2, k1, k2, threshold / 100))
                yield part.select(["v", "w"]).filter(ok)

    joined = pairs.join(a, "v").join(b, "w")
    # sizes first: they need no sketch
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    joined = joined.filter(small * 100 >= large * threshold).select("v", "w", "n1", "n2", "s1", "s2")
    return joined.mapInArrow(run, "v long, w long")


def _components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest node that each node of the edges (a, b) reaches; alternating stars."""
    before = None
    e = edges.select("a", "b").filter("a <> b").distinct()
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = settle(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
        before = now


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row."""
    rows = settle(sketched(docs, text, key), "sketches")
    nodes = rows.filter("n > 0 AND k IS NOT NULL").groupBy("v").agg(
        F.min("k").alias("k"), F.min("n").alias("n"), F.min_by("s", "k").alias("s")
    )
    nodes = settle(nodes, "nodes")
    bands = _bands(nodes, threshold)
    shared = bands.groupBy("bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi")
    members = settle(bands.join(shared.select("bucket"), "bucket"), "members")
    links = _links(docs, text, key, nodes, members, threshold)
    of = nodes.select("v", "k")
    if links is not None:
        comp = settle(_components(links), "components")
        ids = comp.join(of, "v").groupBy("c").agg(F.min("k").alias("id"))
        of = of.join(comp.join(ids, "c").select("v", "id"), "v", "left").select("v", F.coalesce("id", "k").alias("id"))
    else:
        of = of.select("v", F.col("k").alias("id"))
    # empty sets and null ids have no node: their own number spreads them
    side = rows.select("k", "n", F.when(F.expr("n > 0 AND k IS NOT NULL"), F.col("v")).otherwise(F.xxhash64("k")).alias("v"), F.expr("n > 0 AND k IS NOT NULL").alias("is_node"))
    return side.join(of, "v", "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("is_node"), F.col("id")).otherwise(F.col("k")).alias("component_id")
    )


def _links(docs, text, key, nodes, members, threshold) -> DataFrame | None:
    """Verified links (a, b) that make the components of all links; None if there is no bucket to look at."""
    near = settle(nodes.join(members.select("v").distinct(), "v", "left_semi"), "near")
    if near.isEmpty():
        return None
    sets = settle(_sets(docs, text, key, near), "sets")
    weight = members.groupBy("bucket").agg(F.count("*").alias("size"))
    degree = members.join(weight, "bucket").groupBy("v").agg(F.sum("size").alias("d"))
    about = settle(_riding(near).join(degree, "v"), "about")
    state = settle(members.join(about, "v"), "state")
    comp = near.select("v", F.col("v").alias("c"))
    links = done = None
    for turn in range(3):
        live = state.join(comp, "v")
        if turn == 0:
            live = live.filter(F.col("bucket").bitwiseAND(NUMBER) < FIRST_BANDS)
        inside = live.groupBy("bucket", "c").agg(F.count("*").alias("n_c"))
        mixed = inside.groupBy("bucket").agg(
            F.sum("n_c").alias("size"), F.max("n_c").alias("most"), F.max_by("c", F.struct("n_c", "c")).alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi")
        ).filter("lo <> hi")
        live = settle(live.join(mixed.select("bucket", "main", (F.col("size") - F.col("most")).alias("others")), "bucket"), "live")
        if turn < 2:
            hubs = live.join(live.groupBy("bucket").agg(F.max_by("v", F.struct("d", "v")).alias("w")), "bucket").filter("v = w").drop("w")
        else:
            hubs = live.filter(f"others <= {FEW} AND c <> main")
        hubs = settle(hubs.select("bucket", F.col("v").alias("w"), F.col("c").alias("cw"), F.col("m").alias("mw"), F.col("r").alias("rw")), "hubs")
        pairs = _agreeing(live.join(hubs, "bucket").filter("c <> cw"), threshold).distinct()
        if done is not None:
            pairs = pairs.join(done, ["v", "w"], "left_anti")
        pairs = settle(pairs, "pairs")
        found = _verified(_likely(pairs, near, threshold), sets, threshold)
        if turn == 2:
            crowd = _crowd(live.filter(f"others > {FEW}"))
            if crowd is not None:
                found = found.union(_in_blocks(crowd.join(comp, "v"), sets, near, threshold))
        found = settle(found, "links")
        done = pairs if done is None else settle(done.union(pairs), "done")
        if not found.isEmpty():
            links = found if links is None else settle(links.union(found), "links")
            if turn < 2:
                comp = settle(
                    near.select("v").join(_components(links), "v", "left").select("v", F.coalesce("c", "v").alias("c")), "state-components"
                )
        if turn < 2:
            # a hub has met every member of another component: it leaves its bucket
            state = settle(state.join(hubs.select("bucket", F.col("w").alias("v")), ["bucket", "v"], "left_anti").select("bucket", "v", "m", "r", "d"), "state")
    return links


def _crowd(crowded: DataFrame) -> DataFrame | None:
    """(v, g): members of crowded buckets, by groups of those that share buckets; None if there are none."""
    if crowded.isEmpty():
        return None
    least = crowded.groupBy("bucket").agg(F.min("v").alias("b"))
    together = crowded.select("bucket", F.col("v").alias("a")).join(least, "bucket").select("a", "b")
    return settle(_components(together).withColumnRenamed("c", "g"), "crowd")


def _in_blocks(crowd: DataFrame, sets: DataFrame, near: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between sets of different components of a crowd (v, g, c)."""
    blocks = crowd.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("n"))
    own = F.pmod(F.xxhash64("v"), F.col("n"))
    rows = crowd.join(blocks, "g").withColumn("own", own).join(sets, "v").join(_riding(near).select("v", "r"), "v")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "c", "set", "r")

    agree = least_agreeing(threshold)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, own, v, c = (table.column(x).to_numpy() for x in ("i", "own", "v", "c"))
        r = np.frombuffer(b"".join(table.column("r").to_pylist()), np.uint8).reshape(-1, RIDING)
        first = np.flatnonzero(own == i[0])
        second = first if table.column("j")[0].as_py() == i[0] else np.flatnonzero(own != i[0])
        allowed = np.zeros((len(first), len(second)), bool)
        for row, at in enumerate(first):
            allowed[row] = ((r[second] == r[at]).sum(1) >= agree) & (c[second] != c[at])
        a = b = np.empty(0, np.int64)
        if allowed.any():
            sizes, both = _intersections(table.column("set"), first, second)
            ok = allowed & (both * 100 >= (sizes[first][:, None] + sizes[second][None, :] - both) * threshold)
            x, y = np.nonzero(ok)
            a, b = v[first[x]], v[second[y]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def _intersections(column, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all sets, and of the intersections of those at ``first`` with those at ``second``."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, token, often = np.unique(np.asarray(column.flatten()), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # of the shingles that two sets hold
    keep = often[token] > 1
    token, of = number[token[keep]], of[keep]
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    both = np.zeros((len(first), len(second)), np.int64)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, SHINGLES):
        a, b = np.searchsorted(token, (low, low + SHINGLES))
        held = np.zeros((len(sizes), SHINGLES), np.float32)
        held[of[a:b], token[a:b] - low] = 1
        both += (held[first] @ held[second].T).astype(np.int64)
    return sizes, both


def _riding(nodes: DataFrame) -> DataFrame:
    """(v, m, r): size, and low bytes of the first registers, of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(s, np.uint16)[:RIDING].astype(np.uint8).tobytes() for s in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(low, pa.binary())], names=["v", "m", "r"])

    return nodes.select("v", "n", "s").mapInArrow(run, "v long, m long, r binary")


def _agreeing(met: DataFrame, threshold: int) -> DataFrame:
    """Pairs (v, w), smaller first, of bucket members whose sizes and riding registers agree well enough."""
    agree = least_agreeing(threshold)
    met = met.filter(F.least("m", "mw") * 100 >= F.greatest("m", "mw") * threshold).select("v", "w", "r", "rw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RIDING) for c in ("r", "rw"))
                v, w = (np.asarray(batch.column(c)) for c in ("v", "w"))
                ok = (a == b).sum(1) >= agree
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(v, w)[ok]), pa.array(np.maximum(v, w)[ok])], names=["v", "w"]
                )

    return met.mapInArrow(run, "v long, w long")


def _sets(docs: DataFrame, text: str, key: str, near: DataFrame) -> DataFrame:
    """(v, set) of the nodes that share a bucket, from the texts."""
    wanted = near.select(F.col("k"), F.col("v"))
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).join(wanted, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SMALL):
            v, out = [], []
            for t, wanted in zip(texts(batch, "t"), batch.column("v").to_pylist()):
                s = shingles(t)
                if set_hash(s) == wanted:  # a repeated id may have other texts
                    v.append(wanted)
                    out.append(signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["v", "set"])

    return rows.select("t", "v").mapInArrow(run, "v long, set array<long>").dropDuplicates(["v"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets are similar enough, as edges (a, b)."""
    joined = pairs.join(sets.select("v", F.col("set").alias("x")), "v").join(sets.select(F.col("v").alias("w"), F.col("set").alias("y")), "w")
    both = F.size(F.array_intersect("x", "y"))
    return joined.filter(both * 100 >= (F.size("x") + F.size("y") - both) * threshold).select(F.col("v").alias("a"), F.col("w").alias("b"))


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` but for those linked to a smaller id; all columns as they are.

    Rows with the same id are one document: they stay or go together, by the smallest
    component id among them. Rows with a null id stay. Only the ids that go are written for
    good; the tables on the way to them are dropped.
    """
    def ids() -> DataFrame:
        found = groups(docs, text, key, threshold).groupBy(key).agg(F.min("component_id").alias("c"))
        return found.filter(F.col("c") < F.col(key)).select(F.col(key).alias("__gone"))

    gone = settle_alone(docs.sparkSession, ids, "gone")
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
