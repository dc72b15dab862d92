"""Collocations: phrases whose words occur together far more often than their parts let expect.

Every word of a text starts a suffix, cut at the end of its piece. A multikey three-way
quicksort orders suffix pointers word by word down to the longest phrase; the size of an
equal partition at a depth is the count of the phrase of those words. Tasks sort the
suffixes of their own texts first and send each distinct one once, with its count, to the
task that its language and first two words lead to. There the same sort runs over what
all tasks sent; partitions that are too infrequent are abandoned with all below them.

Words occurring fewer than ``least`` times cannot stand in a phrase that is frequent
enough, so suffixes also end before them. Which words may be frequent is told by a bit
table of fixed size; a word let through by chance costs work and changes no result.
Words are compared as 64-bit hashes after they are counted.

Null texts count as empty, a null language as ``und``. Repeated rows count each. Texts
without words add nothing, a table without rows gives no rows, and other columns of the
input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.llm.common import ODD, hashes, mix, signed, slices
from tradeq.session import settle

LEAST, SHORTEST, LONGEST, BEST = 10, 2, 3, 2000
#: Text sorted at once in a task before it is sent, and text whose suffixes one route receives.
SORTED_BYTES, ROUTE_BYTES = 24 << 20, 16 << 20
#: Bits of the table of words that may be frequent: 16 MB, whatever the number of words.
TABLE_BITS, STRIPES = 1 << 27, 64
#: Partitions of up to this size are put in order by one library sort.
SMALL = 1 << 15

BREAK = b"."
#: Ends of pieces become one mark between blanks; a tab parts words like a blank.
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lowered, and ``BREAK`` between pieces."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(PIECES)
    return [w for w in data.replace(b".", b" . ").split(b" ") if w]


def equal_parts(columns: list[np.ndarray], weights: np.ndarray, least: int, lowest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers 0..n-1 whose words are ``columns`` (0: the suffix has ended).

    Yields (depth, pointers, sizes): per equal partition of at least ``least`` at depth
    ``lowest`` or below one of its pointers and its size, the sum of its weights.
    """
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        part, depth = stack.pop()
        if not len(part) or (least > 1 and int(weights[part].sum()) < least):
            continue  # too infrequent, and so is all below
        if len(part) <= SMALL:
            yield from _small(columns, weights, part, depth, least, lowest)
            continue
        word = columns[depth][part]
        pivot = np.sort(word[:: max(1, len(word) // 255)])[128 if len(word) >= 256 else len(word) // 2]
        stack.append((part[word < pivot], depth))
        stack.append((part[word > pivot], depth))
        equal = part[word == pivot]
        if not pivot:
            continue  # these have ended
        size = int(weights[equal].sum())
        if size >= least:
            if depth >= lowest:
                yield depth, equal[:1], np.array([size])
            if depth + 1 < len(columns):
                stack.append((equal, depth + 1))


def _small(columns, weights, part, depth, least, lowest):
    """All equal partitions below a small one, from one sort."""
    keys = [c[part] for c in columns[depth:]]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    part, keys = part[order], [k[order] for k in keys]
    weight = weights[part]
    new = np.zeros(len(part), bool)
    new[:1] = True
    for d, k in enumerate(keys, start=depth):
        new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        size = np.add.reduceat(weight, first)
        if d >= lowest:
            keep = (size >= least) & (k[first] != 0)
            yield d, part[first[keep]], size[keep]


def distinct_suffixes(columns: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pointer and the summed weight of each distinct suffix."""
    at, counts = [], []
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        part, depth = stack.pop()
        if not len(part):
            continue
        if depth == len(columns) or (depth and not columns[depth - 1][part[0]]):
            at.append(part[:1])
            counts.append(weights[part].sum(keepdims=True))
        elif len(part) <= SMALL:
            keys = [c[part] for c in columns[depth:]]
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(part), bool)
            new[:1] = True
            for k in keys:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            at.append(part[order][first])
            counts.append(np.add.reduceat(weights[part[order]], first))
        else:
            word = columns[depth][part]
            pivot = np.sort(word[:: max(1, len(word) // 255)])[128 if len(word) >= 256 else len(word) // 2]
            stack += [(part[word < pivot], depth), (part[word > pivot], depth), (part[word == pivot], depth + 1)]
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(at), np.concatenate(counts)


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(words: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Distinct suffixes as one compressed block: hashes of its words, then numbers of words column by column."""
    used, inverse = np.unique(np.concatenate(columns), return_inverse=True)
    width = np.uint8 if len(used) < 1 << 8 else np.uint16 if len(used) < 1 << 16 else np.uint32
    small = np.uint8 if counts.max(initial=0) < 1 << 8 else np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    head = struct.pack("<IIBBB", len(used), len(counts), len(columns), np.dtype(width).itemsize, np.dtype(small).itemsize)
    return _press(head + words[used].tobytes() + inverse.astype(width).tobytes() + counts.astype(small).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (one row a column of suffixes) and counts of a block."""
    raw = _open(data)
    n_words, n, depth, width, small = struct.unpack_from("<IIBBB", raw)
    at = struct.calcsize("<IIBBB")
    words = np.frombuffer(raw, np.uint64, n_words, at)
    at += 8 * n_words
    numbers = np.frombuffer(raw, f"<u{width}", n * depth, at).reshape(depth, n)
    counts = np.frombuffer(raw, f"<u{small}", n, at + width * n * depth)
    return words[numbers], counts.astype(np.int64)


def _prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")
    )


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    held: dict[str, list[str]] = {}
    for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
        if t:
            held.setdefault(lang, []).append(t)
    yield from held.items()


def _coded(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the text as numbers of words with -1 at ends of pieces and texts."""
    words: list[bytes] = []
    for t in texts:
        words += words_of(t)
        words.append(BREAK)
    found = pa.array(words, pa.binary()).dictionary_encode()
    distinct = found.dictionary.to_pylist()
    codes = found.indices.to_numpy(zero_copy_only=False)
    return distinct, np.where(codes == distinct.index(BREAK), -1, codes) if distinct else codes


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Occurrences of every word per language (lang, word, h, n), ``h`` being its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            for name, texts in _by_lang(batch):
                distinct, codes = _coded(texts)
                n = np.bincount(codes[codes >= 0], minlength=len(distinct))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array([distinct[i] for i in at.tolist()], pa.binary()), pa.array(n[at])],
                    names=["lang", "word", "n"],
                )

    partial = _prepared(docs, text, lang).mapInArrow(run, "lang string, word binary, n long")
    counted = partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _word_hashes(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(h))], names=["lang", "word", "n", "h"])

    return counted.mapInArrow(hashed, "lang string, word binary, n long, h long")


def _word_hashes(words: list[bytes]) -> np.ndarray:
    h = hashes(words)
    h[h == 0] = 1  # 0 stands for the end of a suffix
    return h


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) % np.uint64(bits)).astype(np.int64)


def _bit_table(frequent: DataFrame) -> bytes:
    """The bits of all words of ``frequent``; its size is fixed and it is put together from ``STRIPES`` parts."""
    bits, wide = TABLE_BITS, TABLE_BITS // STRIPES

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column("h").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot // wide).astype(np.int32)), pa.array(slot % wide)], names=["stripe", "at"])

    def part(table: pa.Table) -> pa.Table:
        mine = np.zeros(wide, bool)
        mine[table.column("at").to_numpy()] = True
        return pa.table({"stripe": table.column("stripe").slice(0, 1), "bits": pa.array([_press(np.packbits(mine).tobytes())], pa.binary())})

    # a stripe has at most as many distinct places as it has bits
    places = frequent.select("h").mapInArrow(slots, "stripe int, at long").distinct()
    rows = places.groupBy("stripe").applyInArrow(part, "stripe int, bits binary").collect()
    table = np.zeros((STRIPES, wide // 8), np.uint8)
    for r in rows:
        table[r.stripe] = np.frombuffer(_open(bytes(r.bits)), np.uint8)
    return _press(table.tobytes())


_TABLES: dict[int, np.ndarray] = {}


def _table(broadcast, number: int) -> np.ndarray:
    if number not in _TABLES:
        _TABLES.clear()
        _TABLES[number] = np.frombuffer(_open(broadcast.value), np.uint8)
    return _TABLES[number]


def _phrase_counts(docs: DataFrame, frequent: DataFrame, text: str, lang: str, least: int, longest: int, size: int) -> DataFrame:
    """Counts of all phrases of 2 to ``longest`` words with at least ``least`` (lang, key, n); a key joins the words' hashes."""
    bits = _bit_table(frequent)
    table, number = docs.sparkSession.sparkContext.broadcast(bits), xxhash.xxh3_64_intdigest(bits)
    routes = max(1, -(-size // ROUTE_BYTES))

    def suffixes(texts: list[str]):
        distinct, codes = _coded(texts)
        h = _word_hashes(distinct)
        bits = _table(table, number)
        slot = _slot(h, 8 * len(bits))
        known = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
        # numbers from 1 on; 0 is the end, for breaks and infrequent words as well
        code = np.where((codes >= 0) & known[codes], codes + 1, 0).astype(np.int32)
        code = np.concatenate([code, np.zeros(longest, np.int32)])
        n = len(codes)
        start = np.flatnonzero((code[:n] != 0) & (code[1 : n + 1] != 0))
        columns, alive = [], np.ones(len(start), bool)
        for d in range(longest):
            c = code[start + d]
            alive &= c != 0
            columns.append(np.where(alive, c, 0))
        return np.concatenate([np.zeros(1, np.uint64), h]), columns

    def send(name: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
        h, columns = suffixes(texts)
        at, counts = distinct_suffixes(columns, np.ones(len(columns[0]), np.int64))
        if not len(at):
            return
        columns = [c[at] for c in columns]
        route = (mix(h[columns[0]] * ODD + h[columns[1]]) % np.uint64(routes)).astype(np.int64)
        order = np.argsort(route, kind="stable")
        edges = np.searchsorted(route[order], np.arange(routes + 1))
        blocks, to = [], []
        for r in range(routes):
            mine = order[edges[r] : edges[r + 1]]
            if len(mine):
                blocks.append(pack(h, [c[mine] for c in columns], counts[mine]))
                to.append(r)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(to), pa.string()), pa.array(to, pa.int64()), pa.array(blocks, pa.binary())], names=["lang", "route", "block"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        waiting: dict[str, int] = {}
        for batch in slices(batches, "t"):
            for name, texts in _by_lang(batch):
                held.setdefault(name, []).extend(texts)
                waiting[name] = waiting.get(name, 0) + sum(map(len, texts))
            while sum(waiting.values()) >= SORTED_BYTES:
                name = max(waiting, key=waiting.get)
                del waiting[name]
                yield from send(name, held.pop(name))
        for name, texts in held.items():
            yield from send(name, texts)

    def count(table: pa.Table) -> pa.Table:
        words = counts = None
        for i, block in enumerate(table.column("block").to_pylist(), start=1):
            w, c = unpack(block)
            words = w if words is None else np.concatenate([words, w], axis=1)
            counts = c if counts is None else np.concatenate([counts, c])
            if len(counts) > 1 << 22 and i % 16 == 0:  # what is equal needs room once
                at, counts = distinct_suffixes(list(words), counts)
                words = words[:, at]
        keys, sizes = [], []
        for depth, at, n in equal_parts(list(words), counts, least):
            keys.append([k.tobytes() for k in np.ascontiguousarray(words[: depth + 1, at].T.astype(">u8"))])
            sizes.append(n)
        keys = [k for some in keys for k in some]
        n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        name = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([name] * len(keys), pa.string()), "key": pa.array(keys, pa.binary()), "n": pa.array(n, pa.int64())})

    blocks = _prepared(docs, text, lang).mapInArrow(run, "lang string, route long, block binary")
    return blocks.groupBy("lang", "route").applyInArrow(count, "lang string, key binary, n long")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shortest: int = SHORTEST, longest: int = LONGEST,
    best: int = BEST, share: int = 50,
) -> DataFrame:
    """The first ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate has ``shortest`` to ``longest`` words and a >= ``least`` occurrences. Its
    score is the least floor(10^6 a a / (l r)) over all cuts into a first part (l
    occurrences) and a rest (r); of equal cuts the earliest is told. A candidate whose
    words stand inside a longer candidate of at least ``share`` hundredths of its count
    goes. ``n`` counts all words of the language. Order: score, a (both falling), phrase.
    """
    if not 2 <= shortest <= longest or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    words = settle(word_counts(docs, text, lang), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    phrases = settle(_phrase_counts(docs, frequent, text, lang, least, longest, size), "phrase-counts")
    key_of_word = F.unhex(F.lpad(F.hex("h"), 16, "0"))
    spelled = frequent.select("lang", key_of_word.alias("part"), F.col("word").cast("string").alias("word"), "n")
    parts = spelled.select("lang", "part", "n").unionByName(phrases.select("lang", F.col("key").alias("part"), "n"))

    length = (F.octet_length("key") / 8).cast("int")
    candidates = phrases.withColumn("m", length).filter(F.col("m") >= shortest).withColumnRenamed("n", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumns({"first": F.expr("substring(key, 1, 8 * k)"), "rest": F.expr("substring(key, 8 * k + 1, 8 * (m - k))")})
    cut = cut.join(parts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    exact = cut.withColumns({"a2": F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), "lr": wide("l") * wide("r")})
    scored = exact.withColumn("score", F.expr("a2 div lr")).groupBy("lang", "key", "a", "m").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    def within(size: int) -> DataFrame:
        starts = F.sequence(F.lit(0), F.col("m") - size)
        runs = F.transform(starts, lambda i: F.col("key").substr(i * 8 + 1, F.lit(8 * size)))
        return candidates.filter(F.col("m") > size).select("lang", F.col("a"), F.explode(runs).alias("key"))

    inside = reduce(DataFrame.unionByName, map(within, range(shortest, longest)), candidates.limit(0).select("lang", "a", "key"))
    longer = inside.groupBy("lang", "key").agg(F.max("a").alias("within"))
    kept = scored.join(longer, ["lang", "key"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
    flat = kept.select("lang", "key", "m", "a", "cut.l", "cut.r", "cut.score")

    # no text is looked up for what cannot be among the first; ties at the border stay
    near = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    flat = flat.withColumn("place", F.rank().over(near)).filter(F.col("place") <= best).drop("place")
    for i in range(longest):
        flat = flat.withColumn("part", F.expr(f"CASE WHEN m > {i} THEN substring(key, {8 * i + 1}, 8) END"))
        flat = flat.join(spelled.select("lang", "part", F.col("word").alias(f"w{i}")), ["lang", "part"], "left").drop("part")
    flat = flat.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(longest)]))
    final = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
