"""Toxicity by compression distance.

Two zstandard dictionaries are made from training texts, one of words that mark
toxic texts, one of ordinary words. Every window of a text (one word in a frame
that both dictionaries hold) is compressed with both; how many bytes the toxic
dictionary saves is the window's distance. How many windows lie beyond several
distances, by themselves and against what ordinary texts of that length have, is
turned into a probability by a calibration on training texts whose words the
dictionaries did not see.

Words are told apart from common ones by their distinct contexts (word before, word,
word after), so copies of a text count once. Dictionaries hold chosen words as raw
content: on short windows zstandard's own trainer fills them with fragments that
ordinary words match as well (measured: F1 0.80 against 0.99).

Training takes a bounded sample of labelled rows (``PER_CLASS`` per label in
expectation) and their whole texts. Null and empty texts have no window and get the
score of a text without any sign. Without toxic or without ordinary training rows the
score is 0. Equal texts get equal scores; only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.llm.bpe import Memory
from tradeq.llm.common import slices, texts

#: Labelled training rows per label, in expectation.
PER_CLASS = 3000
#: Bytes of each dictionary.
SIZE = 32768
LEVEL = 9
#: Byte n-grams by which toxic words are found, and the evidence (log likelihood ratio) asked of them.
GRAM, EVIDENCE = 5, 16.0
#: Distances (bytes saved) beyond which windows are counted.
STEPS = (2, 3, 4, 5, 6)
#: Windows below which the length of a text tells nothing.
SHORT = 30
#: Stands after every window: compressors look for no match in the last bytes of a block.
FRAME = b"<~window:0123456789abcdef~>"

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[bytes]:
    """Runs of letters and digits, A-Z lowered."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def dictionaries(toxic: Counter, ordinary: Counter) -> tuple[bytes, bytes]:
    """Contents of both dictionaries from the words' context counts; often used words stand last, where they are near."""
    in_toxic, in_ordinary = Counter(), Counter()
    for counts, into in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for w, n in counts.items():
            for g in grams(w):
                into[g] += n
    ratio = sum(toxic.values()) / max(1, sum(ordinary.values()))

    def marks(g: bytes, n: int) -> bool:
        expected = ratio * (in_ordinary[g] + 0.5)
        return n > 3 * expected and n * math.log(n / expected) - (n - expected) >= EVIDENCE

    rich = {g for g, n in in_toxic.items() if marks(g, n)}
    telling = {w for w in toxic if not rich.isdisjoint(grams(w))}

    def content(counts: Counter, chosen) -> bytes:
        ordered, size = [], 0
        for w, _ in sorted(((w, n) for w, n in counts.items() if chosen(w)), key=lambda x: (-x[1], x[0])):
            ordered.append(b" " + w + b" ")
            size += len(w) + 2
            if size >= SIZE:
                break
        return b"".join(reversed(ordered))[-SIZE:] + FRAME

    return content(toxic, telling.__contains__), content(ordinary, lambda w: w not in telling)


class Distances:
    """Bytes that the toxic dictionary saves on a word, remembered in bounded memory."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.toxic, self.ordinary = (
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            for c in contents
        )
        self.of = Memory(self._saved)

    def _saved(self, word: bytes) -> int:
        window = b" " + word + b" " + FRAME
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))

    def counts(self, text: str) -> list[float]:
        """Windows beyond each step, and all windows."""
        found = words(text)
        saved = np.array(self.of.many(found), np.int32)
        return [*(float((saved >= s).sum()) for s in STEPS), float(len(found))]


def features(counts: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Logarithms of the counts, and of their ratios to what the ``usual`` shares make of the length.

    Texts shorter than ``SHORT`` windows count as about as long: training has too few to learn from.
    """
    beyond, n = counts[:, :-1], counts[:, -1:]
    return np.column_stack([np.log((beyond + 0.5) / (usual * n + 0.5)), np.log1p(beyond), np.log(n + SHORT)])


@dataclass
class Model:
    """Dictionary contents and the weights of the calibration; no weights: nothing could be learned."""

    contents: tuple[bytes, bytes]
    weights: np.ndarray | None
    usual: np.ndarray | None = None  # share of windows beyond each step in ordinary texts

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(counts))
        x = features(counts, self.usual)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, rows weighed by ``share``; Newton steps with halving."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-3)
    share = share / share.mean()

    def cost(w):
        z = np.clip(x @ w, -30, 30)
        return (share * (np.logaddexp(0, z) - y * z)).mean() + 0.5 * (ridge * w * w).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) / len(x) + ridge * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows; repeated labels of an id count as toxic if one of them is."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model((FRAME, FRAME), None)
    part = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / (1 << 20)
    keep = F.when(F.col("y") == 1, F.lit(per_class / counts[1])).otherwise(F.lit(per_class / counts[0]))
    # at most about 2 * per_class ids: small enough to send to every task, whatever the input
    sample = known.filter(part < keep)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(sample), "k")
    rows = rows.select("t", "y", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("fold"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out: dict[tuple, bytes] = {}
            for t, y, fold in zip(texts(batch, "t"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
                w = words(t)
                for a, b, c in zip([b"", *w], w, [*w[1:], b""]):
                    out.setdefault((y, xxhash.xxh3_64_intdigest(b"\0".join((a, b, c)))), (fold, b))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in out], pa.int32()),
                    pa.array(np.array([k[1] for k in out], np.uint64).view(np.int64)),
                    pa.array([v[0] for v in out.values()], pa.int32()),
                    pa.array([v[1] for v in out.values()], pa.binary()),
                ],
                names=["y", "c", "fold", "w"],
            )

    seen = rows.mapInArrow(contexts, "y int, c long, fold int, w binary").groupBy("y", "c").agg(F.min("fold").alias("fold"), F.min("w").alias("w"))
    table = seen.groupBy("y", "fold", "w").agg(F.count("*").alias("n")).toPandas()
    counted = {(y, f): Counter() for y in (0, 1) for f in (0, 1)}
    for y, fold, w, n in zip(table["y"], table["fold"], table["w"], table["n"]):
        counted[y, fold][bytes(w)] = int(n)
    halves = [dictionaries(counted[1, f], counted[0, f]) for f in (0, 1)]
    contents = dictionaries(counted[1, 0] + counted[1, 1], counted[0, 0] + counted[0, 1])
    sent = spark.sparkContext.broadcast(halves)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [Distances(c) for c in sent.value]
        for batch in slices(batches, "t"):
            folds = batch.column("fold").to_pylist()
            got = [tools[1 - f].counts(t) for t, f in zip(texts(batch, "t"), folds)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measured, "y int, x array<double>").toPandas()
    if got["y"].nunique() < 2:
        return Model(contents, None)
    y = got["y"].to_numpy(float)
    x = np.array(got["x"].tolist())
    share = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    plain = x[y == 0]
    usual = plain[:, :-1].sum(0) / max(1, plain[:, -1].sum())
    order = np.lexsort((*x.T, y))  # rows arrive in any order: the same sums every time
    return Model(contents, calibrate(features(x, usual)[order], y[order], share[order]), usual)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tool = Distances(model.contents)
        for batch in slices(batches, "t"):
            x = np.array([tool.counts(t) for t in texts(batch, "t")])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.scores(x))], names=["k", "score"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)
