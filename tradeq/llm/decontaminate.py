"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Every document is a query, as a whole: an item's parts may stand far apart in it. A
posting's weight is its BM25 weight divided by the item's own score, so an item whose
words all stand in a document scores 1. A document that holds the asked share of an
item's 5-word runs lacks few of its words; what these can weigh at most is known per
item, and the item's threshold is low enough for that. Bounds of blocks of items skip
nearly everything; what is left is scored by WAND, and items above their threshold
are verified: shares of the item's 5-word runs, and of those of its question and its
answer, in the document.

The index is split into shards of bounded size; each shard is sent to the tasks and
all documents pass by it. Items without words match nothing, nor do null and empty
texts. Repeated items and documents each give their own rows; rows with a null id
are searched like others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tradeq.llm.common import slices, texts

K1, B = 1.2, 0.75
#: Share of an item's own score from which a document retrieves it; less where its runs allow less.
RETRIEVE = 0.6
#: Share of an item's 5-word runs that must stand in the document, and of its question's and answer's.
OVERLAP, PART = 0.8, 0.5
RUN = 5
#: Words of the items of one shard, in expectation; bounds what a task holds of the index.
SHARD_WORDS = 1 << 17
#: Blocks of items of a segment at most.
BLOCKS = 256


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_runs(words: list[bytes]) -> set[tuple]:
    """Distinct runs of 5 words; fewer words are one run."""
    if len(words) < RUN:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(RUN)]))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words before its last line, and of it; of the last sentence where it has one line.

    An item of one line with one sentence is all question.
    """
    lines = [w for w in (split_words(line) for line in text.split("\n")) if w]
    if len(lines) > 1:
        return [w for line in lines[:-1] for w in line], lines[-1]
    words = lines[0] if lines else []
    ends = [i for i, w in enumerate(words[:-1]) if w.rstrip(b"\"')]").endswith((b".", b"!", b"?"))]
    if not ends:
        return words, []
    return words[: ends[-1] + 1], words[ends[-1] + 1 :]


@dataclass
class Item:
    """A test item with what its verification needs."""

    key: object
    words: list[bytes]
    question: set
    answer: set
    runs: set
    raised: float = 1.0

    def shares(self, runs: set) -> tuple[int, float, float]:
        part = lambda p: len(p & runs) / len(p) if p else 1.0
        return len(self.runs & runs), part(self.question), part(self.answer)


class Segment:
    """The inverted index of the items of one length class."""

    def __init__(self, length: int, items: list[Item], weights: list[dict[bytes, float]]):
        self.length, self.items = length, items
        self.terms: dict[bytes, int] = {}
        self.local = np.empty(0, np.int32)
        postings: list[list[tuple[int, float]]] = []
        for i, w in enumerate(weights):
            for word, weight in w.items():
                t = self.terms.setdefault(word, len(self.terms))
                if t == len(postings):
                    postings.append([])
                postings[t].append((i, weight))
        self.postings = postings
        self.block = math.ceil(len(items) / BLOCKS)
        self.most = np.zeros((len(postings), math.ceil(len(items) / self.block)), np.float32)
        for t, list_ in enumerate(postings):
            for i, weight in list_:
                self.most[t, i // self.block] = max(self.most[t, i // self.block], weight)

    def number(self, vocabulary: dict[bytes, int]) -> None:
        """Learn which of the shard's term numbers are this segment's terms; the last place is for none."""
        self.local = np.full(len(vocabulary) + 1, -1, np.int32)
        self.local[[vocabulary[w] for w in self.terms]] = list(self.terms.values())

    def search(self, numbers: np.ndarray, threshold: float) -> dict[int, float]:
        """Items that a document retrieves, with their scores; ``numbers`` are its terms in the shard."""
        query = self.local[numbers]
        query = query[query >= 0]
        if len(query) == 0:
            return {}
        near = np.flatnonzero(self.most[query].sum(0) >= threshold - 1e-3)
        query = query.tolist()
        return {i: s for k in near.tolist() for i, s in self.wand(query, k, threshold)}

    def wand(self, query: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of a block whose score reaches the threshold, in order of items."""
        low, high = block * self.block, (block + 1) * self.block
        cursors = []  # per term: bound in this block, its postings there, position
        for t in query:
            bound = float(self.most[t, block])
            if bound > 0:
                cursors.append([0, [p for p in self.postings[t] if low <= p[0] < high], bound])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]][0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[2]
                if total >= threshold - 1e-6:
                    pivot = c[1][c[0]][0]
                    break
            if pivot is None:
                break  # all that is left cannot reach the threshold together
            if cursors[0][1][cursors[0][0]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[1][c[0]][0] == pivot:
                        score += c[1][c[0]][1]
                        c[0] += 1
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
            else:
                for c in cursors:
                    while c[0] < len(c[1]) and c[1][c[0]][0] < pivot:
                        c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out


def least_score(words: list[bytes], weights: dict[bytes, float]) -> float:
    """The least share of an item's score in a document that holds ``OVERLAP`` of its runs; weights add up to 1.

    A word is only missing if all runs with it are, and a run has at most ``RUN`` words, so the
    missing words' numbers of runs add up to at most that many times the missing runs.
    """
    runs = word_runs(words)
    room = RUN * math.floor((1 - OVERLAP) * len(runs) + 1e-9)
    within = Counter(w for r in runs for w in set(r))
    missing = 0.0
    for word, weight in sorted(weights.items(), key=lambda x: -x[1] / within[x[0]]):
        if room <= 0:
            break
        missing += weight * min(1.0, room / within[word])
        room -= within[word]
    return 1 - missing


class Shard:
    """Part of the items, by length class."""

    def __init__(self, rows: list[dict]):
        by_class: dict[int, list[dict]] = {}
        for r in rows:
            by_class.setdefault(max(8, 1 << (r["n"] - 1).bit_length()), []).append(r)
        self.segments = []
        for length, own in sorted(by_class.items()):
            items, weights = [], []
            for r in own:
                question, answer = question_and_answer(r["text"])
                words = split_words(r["text"])
                # runs that touch a part; a part may be shorter than a run
                first, last = words[: len(question) + RUN - 1], words[max(0, len(question) - RUN + 1) :] if answer else []
                items.append(Item(r["item"], words, word_runs(first), word_runs(last), word_runs(words)))
                raw = {w.encode(): weight for w, weight in zip(r["terms"], r["weights"])}
                own_score = sum(raw.values())
                share = {w: x / own_score for w, x in raw.items()}
                # raised where the item must be found from a lower score, so that one threshold holds for all
                raised = RETRIEVE / max(1e-6, min(RETRIEVE, least_score(words, share)))
                items[-1].raised = raised
                weights.append({w: x * raised for w, x in share.items()})
            self.segments.append(Segment(length, items, weights))
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in self.segments for w in s.terms))}
        for segment in self.segments:
            segment.number(self.vocabulary)

    def matches(self, text: str, threshold: float = RETRIEVE) -> list[tuple[object, float, int, int, float, float]]:
        """(item, score, shared runs, runs of the item, question's share, answer's share) of what is verified."""
        words = split_words(text)
        numbers = np.unique(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        numbers = numbers[numbers >= 0]
        out, runs = [], None
        for segment in self.segments:
            for i, score in segment.search(numbers, threshold).items():
                if runs is None:
                    runs = word_runs(words)
                item = segment.items[i]
                shared, question, answer = item.shares(runs)
                if shared >= OVERLAP * len(item.runs) - 1e-9 and question >= PART and answer >= PART:
                    out.append((item.key, min(1.0, score / item.raised), shared, len(item.runs), question, answer))
        return out


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def index(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Shard]:
    """The shards of the index, one after the other; weights come from counts over all items."""
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    rows = (
        items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
        .withColumn("words", F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .filter(F.size("words") > 0)
        .distinct()
        .withColumn("n", F.size("words"))
        .withColumn("row", F.xxhash64("item", "text"))
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not total["n"]:
        return
    average = total["words"] / total["n"]
    shards = math.ceil(total["words"] / SHARD_WORDS)
    counted = rows.select("row", F.explode("words").alias("w")).groupBy("row", "w").agg(F.count("*").alias("tf"))
    documents = counted.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = (
        counted.join(documents, "w")
        .join(rows.select("row", "n"), "row")
        .withColumn("weight", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / average)))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("w", "weight"))).alias("list"))
    )
    whole = rows.join(weighed, "row").select(
        "item", "text", "n", "row", F.col("list.w").alias("terms"), F.col("list.weight").alias("weights")
    )
    for k in range(shards):
        own = whole.filter(F.pmod("row", F.lit(shards)) == k).orderBy("n", "row") if shards > 1 else whole.orderBy("n", "row")
        yield Shard([r.asDict() for r in own.collect()])


def find(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document and item it holds: ids, ``score``, ``n_shared``, ``n_runs``, ``question``, ``answer``."""
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    schema = T.StructType(
        [T.StructField("k", docs.schema[key].dataType), T.StructField("item", items.schema[item_key].dataType)]
        + [T.StructField("score", T.DoubleType()), T.StructField("n_shared", T.LongType()), T.StructField("n_runs", T.LongType())]
        + [T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())]
    )
    kinds = [to_arrow_type(items.schema[item_key].dataType), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def passing(shard) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "t"):
                at, got = [], []
                for i, t in enumerate(texts(batch, "t")):
                    for m in sent.value.matches(t):
                        at.append(i)
                        got.append(m)
                if got:
                    columns = list(zip(*got))
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    keys = batch.column("k").take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *arrays], names=schema.names)

        return rows.mapInArrow(run, schema)

    found = [passing(s) for s in index(items, item_key)]
    out = reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("k", key).withColumnRenamed("item", item_key)


def without(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns as they are, no shuffle."""
    names = docs.columns
    kept = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    for shard in index(items, item_key):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, f"c{at}"):
                yield batch.filter(pa.array([not sent.value.matches(t) for t in texts(batch, f"c{at}")]))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.toDF(*names)
