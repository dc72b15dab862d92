"""Token counts without ids.

The pieces of a pre-token are counted once per distinct pre-token of the corpus.
Per-document pre-token frequencies are joined to these counts and summed.

The frequent pre-tokens (a bounded number, with exact counts) are joined inside
the map over the documents; all other rows join by hash in a shuffle. Both ways
give the same sum, so the bound only decides where a row is joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.llm.bpe import Memory, loaded, share
from tradeq.llm.common import frequent_bound, hashes, row_ids, signed, slices, texts
from tradeq.session import settle

#: Pre-tokens joined in the map: at most this many, about 10 MB.
FREQUENT = 1 << 18


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """Tokens of every whole text: ``key``, ``n_bytes`` (UTF-8), ``n_tokens``.

    One row per input row, repeated ids included. Null and empty texts count 0.
    A special string inside a text counts as one token.
    """
    shared = share(docs, path)
    plain = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared)
        seen: Counter = Counter()

        def out():
            pieces: dict[str, int] = {}
            for chunk, n in seen.items():
                for p in vocabulary.split.findall(chunk):
                    pieces[p] = pieces.get(p, 0) + n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"]
            )

        for batch in slices(batches, "t"):
            for t in texts(batch, "t"):
                for special, strings in vocabulary.parts(t):
                    if not special:
                        seen.update(strings)
            if len(seen) > 500_000:  # what a worker holds
                yield out()
        if seen:
            yield out()

    distinct = plain.mapInArrow(local, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared)
        for batch in batches:
            words = batch.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("piece"),
                    pa.array(signed(hashes(words))),
                    batch.column("n"),
                    pa.array([len(vocabulary.merge(w)) for w in words], pa.int32()),
                ],
                names=["piece", "h", "n", "size"],
            )

    counted = settle(distinct.mapInArrow(pieces, "piece string, h long, n long, size int"), "token-pieces")
    least = frequent_bound(counted, "n", frequent)
    known = docs.sparkSession.sparkContext.broadcast(
        {r.piece: r["size"] for r in counted.filter(F.col("n") >= least).select("piece", "size").collect()}
    )

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, sizes, ids = loaded(shared), known.value, row_ids()

        def joined(chunk: str) -> tuple[int, list[str]]:
            """Pieces of the frequent pre-tokens of a chunk, and its other pre-tokens."""
            found = [(w, sizes.get(w)) for w in vocabulary.split.findall(chunk)]
            return sum(n for _, n in found if n is not None), [w for w, n in found if n is None]

        chunk = Memory(joined)
        for batch in slices(batches, "t"):
            rows, n_bytes, sums, rare, often = [], [], [], [], []
            for t in texts(batch, "t"):
                rows.append(next(ids))
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                total, rest = 0, Counter()
                for special, strings in vocabulary.parts(t):
                    if special:
                        total += 1
                        continue
                    for n, others in chunk.many(strings):
                        total += n
                        if others:
                            rest.update(others)
                sums.append(total)
                rare.append(signed(hashes(list(rest))))
                often.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    batch.column("k"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rare, pa.list_(pa.int64())),
                    pa.array(often, pa.list_(pa.int64())),
                ],
                names=["row", "k", "n_bytes", "known", "h", "m"],
            )

    kind = docs.schema[key].dataType.simpleString()
    per = plain.mapInArrow(per_document, f"row long, k {kind}, n_bytes long, known long, h array<long>, m array<long>")
    rare = per.select("row", "k", "n_bytes", "known", F.explode_outer(F.arrays_zip("h", "m")).alias("z")).select(
        "row", "k", "n_bytes", "known", F.col("z.h").alias("h"), F.col("z.m").alias("m")
    )
    # rows without a rare pre-token need no partner: their own number spreads them over the partitions
    rare = rare.withColumn("h", F.coalesce("h", F.xxhash64("row")))
    sizes = counted.filter(F.col("n") < least).select("h", "size")
    return (
        rare.join(sizes, "h", "left")
        .groupBy("row")
        .agg(
            F.first("k").alias("k"),
            F.first("n_bytes").alias("n_bytes"),
            (F.first("known") + F.coalesce(F.sum(F.col("m") * F.col("size")), F.lit(0))).alias("n_tokens"),
        )
        .select(F.col("k").alias(key), "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"))
    )
