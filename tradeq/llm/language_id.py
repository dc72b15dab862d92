"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier per bit, over byte n-grams of
the text, tells which half of the languages a text belongs to. Decoding weighs the
loss of every bit by how well its classifier separates, takes the nearest codeword
and flags a text whose second codeword is almost as near.

Texts that are null or have no letter are ``und`` with score 0. Training takes a
bounded sample of labelled rows (``PER_LANGUAGE`` per language in expectation, by a
hash of the text) and their whole texts; without any labelled row all texts are ``und``.
Equal texts get equal predictions; only the text is an input of a prediction.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeq.llm.common import slices, texts

#: Training rows per language, in expectation.
PER_LANGUAGE = 3000
#: Hash buckets of byte 3-grams.
BITS = 16
BUCKETS = 1 << BITS
#: Bytes whose n-grams are weighed at once.
BLOCK = 1 << 18
#: Share by which the second codeword may be the worse and still count as equally near.
AMBIGUOUS = 0.1

LETTER = regex.compile(r"\p{L}")
#: Bytes that are no letters count as blanks; A-Z are lowered.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +1/-1: exhaustive codes for few languages, else the best of many random ones."""
    if k <= 5:
        columns = [[1, *(1 if (c >> i) & 1 else -1 for i in range(k - 1))] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, np.int8).T if k > 1 else np.ones((k, 1), np.int8)
    length = int(np.ceil(10 * np.log2(k)))
    draw = random.Random(k)
    best, best_distance = None, -1
    for _ in range(200):
        code = np.array([[draw.choice((-1, 1)) for _ in range(length)] for _ in range(k)], np.int8)
        if (np.abs(code.sum(0)) == k).any():
            continue  # a bit that is equal everywhere tells nothing
        agree = code.astype(int) @ code.T
        distance = ((length - agree) // 2 + length * np.eye(k, dtype=int)).min()
        if distance > best_distance:
            best, best_distance = code, distance
    return best


def grams(text: str) -> np.ndarray:
    """Buckets of the byte 3-grams of a text, letters only, runs of blanks as one."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Languages, their codewords, a weight per bucket and bit, and each bit's scale and trust."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Mean evidence of each bit over the whole text."""
        g = grams(text)
        total = np.zeros(self.weights.shape[1])
        for a in range(0, len(g), BLOCK):
            total += self.weights[g[a : a + BLOCK]].sum(0, dtype=np.float64)
        return total / len(g) / self.scale

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether two languages are about equally near."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -3 * self.code * self.margins(text)) @ self.trust
        order = np.argsort(loss, kind="stable")
        near = np.exp(-4 * (loss - loss[order[0]]))
        first, second = loss[order[0]], loss[order[1]]
        return self.languages[order[0]], float(1 / near.sum()), bool(second - first < AMBIGUOUS * second)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` with a language; everything that reaches the driver is bounded by languages x buckets."""
    rows = docs.select(docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")
    )
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(0))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / counts[l]))])
    sample = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.element_at(share, F.col("l")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every document weighs the same, however long; an even and an odd part by text length, the second to test
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in slices(batches, "t"):
            for t, l in zip(texts(batch, "t"), batch.column("l").to_pylist()):
                g = grams(t)
                key = (l, len(t) % 2)
                if key not in sums:
                    sums[key] = np.zeros(BUCKETS)
                b, n = np.unique(g, return_counts=True)
                sums[key][b] += n / len(g)
        for (l, half), v in sums.items():
            b = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(b)), pa.array([half] * len(b), pa.int32()), pa.array(b, pa.int32()), pa.array(v[b])],
                names=["l", "half", "b", "v"],
            )

    at = {l: i for i, l in enumerate(languages)}
    sums = np.zeros((2, len(languages), BUCKETS))
    found = sample.mapInArrow(count, "l string, half int, b int, v double").groupBy("l", "half", "b").agg(F.sum("v").alias("v"))
    pulled = found.toPandas()
    sums[pulled["half"], pulled["l"].map(at).to_numpy(int), pulled["b"]] = pulled["v"]
    code = codewords(len(languages))
    both = _weights(sums.sum(0), code)
    # trust: how far the bits of one half tell the languages of the other half apart
    trust = np.ones(code.shape[1])
    scale = np.ones(code.shape[1])
    for half in (0, 1):
        if sums[half].any(1).all() and sums[1 - half].any(1).all():
            profile = sums[half] / sums[half].sum(1, keepdims=True)
            right = (profile @ _weights(sums[1 - half], code)) * code
            trust += np.maximum(right.min(0), 0) / max(right.mean(), 1e-9)
    profile = sums.sum(0) / np.maximum(sums.sum((0, 2))[:, None], 1e-12)
    scale = np.maximum(np.abs(profile @ both).mean(0), 1e-6)
    return Model(languages, code, both.astype(np.float32), scale, trust / trust.sum())


def _weights(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds of a bucket between the languages with bit +1 and those with -1, smoothed."""
    p = (sums + 1e-3) / (sums + 1e-3).sum(1, keepdims=True)
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    up = (p.T @ plus) / np.maximum(plus.sum(0), 1)
    down = (p.T @ minus) / np.maximum(minus.sum(0), 1)
    return np.log(np.maximum(up, 1e-12)) - np.log(np.maximum(down, 1e-12))


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``ambiguous`` of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return predictions(docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")), shared).select(
        F.col("k").alias(key), "lang_pred", "score", "ambiguous"
    )


def predictions(rows: DataFrame, shared) -> DataFrame:
    """Add the prediction of column ``t`` to the other columns of ``rows`` (``t`` stays)."""
    schema = T.StructType(list(rows.schema.fields))
    schema = schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "t"):
            got = [model.predict(t) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and one nearest language; all columns as they are, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, at):
            yield batch.filter(pa.array([bool(LETTER.search(t)) and not model.predict(t)[2] for t in texts(batch, at)]))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
