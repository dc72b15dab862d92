"""Byte-pair encoding and decoding with a public vocabulary file.

A pre-token starts as a doubly linked list of symbols. Merges wait in a priority
queue by rank, then position; an entry whose symbols have changed since is stale
and skipped. Decoding puts vocabulary strings together.

Null text counts as empty and gives no ids. Every other column of the input is
ignored apart from those asked for in ``keep``; equal rows give equal results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradeq.llm.common import SMALL, slices, texts

#: Entries of one generation of a worker's memory of chunks, and of pre-tokens; two generations are kept.
REMEMBERED, REMEMBERED_WORDS = 150_000, 160_000

# The split rule of byte-level vocabularies whose file names the rule only.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


DOUBLE_SPACE = re.compile(r"\s\s")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = dict.fromkeys(plain)
    out, spare = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """One tokenizer file: split rules, pieces and merge ranks."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE files are read")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        alphabet = byte_alphabet()
        self.first = [self.ids.get(c, -1) for c in alphabet]
        self.last = [self.ids.get(c + self.suffix, -1) for c in alphabet]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = [self.ids[a + b] for a, b in merges]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.steps = self._steps(spec.get("normalizer"))
        self.split = self._split(spec["pre_tokenizer"])
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.blanks_kept = not self.suffix
        self.words = Memory(lambda word: tuple(self.merge(word)), REMEMBERED_WORDS)
        self.chunks_of: dict[tuple[str, ...], Memory] = {}

    @staticmethod
    def _steps(spec) -> list:
        steps = []
        for s in (spec or {}).get("normalizers", [spec] if spec else []):
            if s["type"] == "NFC":
                steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
            elif s["type"] == "Replace":
                rule = s["pattern"]["Regex"]
                if (rule, s["content"]) == (r"\s+", " "):
                    rule = r"\s\s+|[^\S ]"  # the same, without touching the single blanks
                pattern, content = regex.compile(rule), s["content"].replace("\\", r"\\")
                steps.append(lambda t, p=pattern, c=content: p.sub(c, t))
            elif s["type"] == "Lowercase":
                # character by character: a capital sigma never becomes a final one
                steps.append(lambda t: t.replace("Σ", "σ").lower())
            else:
                raise ValueError(f"unknown normalizer {s['type']}")
        return steps

    @staticmethod
    def _split(spec):
        for s in spec.get("pretokenizers", [spec]):
            if s["type"] == "Split":
                if s["behavior"] != "Removed" or not s["invert"]:
                    raise ValueError("unknown split rule")
                return regex.compile(s["pattern"]["Regex"])
            if s["type"] == "ByteLevel" and s["use_regex"] and not s["add_prefix_space"]:
                return regex.compile(BYTE_LEVEL_SPLIT)
        raise ValueError("unknown pre-tokenizer")

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(special, strings): marked special strings alone, all else as chunks."""
        pieces = self.marks.split(text) if self.marks and "<" in text else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield True, [piece]
            elif piece:
                for step in self.steps:
                    piece = step(piece)
                yield False, self.chunks(piece)

    def chunks(self, piece: str) -> list[str]:
        """Strings that can be split into pre-tokens one by one.

        A word with the blank before it is such a string as long as no two white
        space characters stand together; otherwise the pre-tokens themselves are.
        """
        if not self.blanks_kept:
            return [c for c in piece.split(" ") if c]
        if DOUBLE_SPACE.search(piece) or "\0" in piece:
            return self.split.findall(piece)
        return piece.replace(" ", "\0 ").split("\0") if piece[0] != " " else piece.replace(" ", "\0 ").split("\0")[1:]

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        end = len(data) - 1
        symbol = [self.first[b] for b in data[:end]]
        symbol.append(self.last[data[end]])
        if end == 0:
            return symbol
        rank, merged = self.rank, self.merged
        after = list(range(1, end + 2))
        after[end] = -1
        before = list(range(-1, end))
        queue = []
        for i in range(end):
            r = rank.get((symbol[i], symbol[i + 1]))
            if r is not None:
                queue.append((r, i, symbol[i], symbol[i + 1]))
        heapify(queue)
        while queue:
            r, i, a, b = heappop(queue)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # stale: one of the two has been merged since
            symbol[i] = new = merged[r]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = rank.get((new, symbol[k]))
                if r is not None:
                    heappush(queue, (r, i, new, symbol[k]))
            p = before[i]
            if p >= 0:
                r = rank.get((symbol[p], new))
                if r is not None:
                    heappush(queue, (r, p, symbol[p], new))
        return [s for s in symbol if s >= 0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of ids with blanks between, as a file without decoder asks."""
        return " ".join([self.pieces[i] for i in ids])

    def _form(self, ids: list[int], kind: str):
        """Ids in one of the forms that are put together: packed integers, text, or vocabulary strings."""
        if kind == "ids":
            return np.array(ids, np.int32).tobytes()
        return " ".join(map(str, ids)) if kind == "ids_text" else self.decode(ids)

    def encode(self, text: str, kinds: tuple[str, ...] = ("ids", "ids_text", "decoded")) -> list[tuple]:
        """Per chunk the asked forms of its ids."""

        def chunk(c: str) -> tuple:
            ids = [i for w in self.split.findall(c) for i in self.words(w)]
            return tuple(self._form(ids, k) for k in kinds)

        if kinds not in self.chunks_of:
            self.chunks_of.clear()  # a worker remembers the forms of one job
            self.chunks_of[kinds] = Memory(chunk)
        many, out = self.chunks_of[kinds].many, []
        for special, strings in self.parts(text):
            if special:
                out.append(tuple(self._form([self.special[strings[0]]], k) for k in kinds))
            else:
                out += many(strings)
        return [c for c in out if c[0]]


class Memory:
    """A function with a bounded memory of two generations; the older one is dropped when the younger is full."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __call__(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def many(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            found = [f if f is not None else self(k) for f, k in zip(found, keys)]
        return found


_LOADED: dict[int, Vocabulary] = {}


def loaded(shared) -> Vocabulary:
    """The vocabulary of a broadcast file, built once per worker."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = Vocabulary(shared.value)
    return _LOADED[shared.id]


class _Shared:
    """A broadcast file with a number to know it by."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def share(df: DataFrame, path: str) -> _Shared:
    """Send a vocabulary file (a few MB, whatever the input) to the workers."""
    with open(path, "rb") as f:
        raw = f.read()
    return _Shared(df.sparkSession.sparkContext.broadcast(raw), xxhash.xxh3_64_intdigest(raw))


OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "ids_text": T.StringType(), "decoded": T.StringType()}


def encode(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """Encode and decode every whole text.

    Returns the ``keep`` columns, ``n_tokens`` and the ``outputs``: ``ids`` (array),
    ``ids_text`` (decimal ids joined by one blank), ``decoded`` (what the ids stand for).
    Null and empty texts have no ids and empty strings. No shuffle: one pass over the rows.
    """
    if not outputs:
        raise ValueError("name at least one output")
    outputs = tuple(outputs)
    shared = share(docs, path)
    kept = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].cast("string").alias("t"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), *[T.StructField(o, OUTPUTS[o]) for o in outputs]])
    width = len(keep)
    # with packed ids at hand a worker remembers these alone: the other forms follow from all ids of a text
    kinds = ("ids",) if "ids" in outputs else outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared)
        for batch in slices(batches, "t", SMALL):
            made = {o: [] for o in outputs}
            counts = []
            for t in texts(batch, "t"):
                columns = list(zip(*vocabulary.encode(t, kinds))) or [()] * len(kinds)
                for o, pieces in zip(kinds, columns):
                    made[o].append((b"" if o == "ids" else " ").join(pieces))
                # all forms but the packed one have a blank between two ids
                first = made[kinds[0]][-1]
                counts.append(len(first) // 4 if kinds[0] == "ids" else first.count(" ") + 1 if first else 0)
                if len(kinds) < len(outputs):
                    ids = np.frombuffer(first, np.int32).tolist()
                    for o in outputs:
                        if o not in kinds:
                            made[o].append(vocabulary.decode(ids) if o == "decoded" else " ".join(map(str, ids)))
            columns = [batch.column(i) for i in range(width)] + [pa.array(counts, pa.int64())]
            for o in outputs:
                if o == "ids":
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    values = np.frombuffer(b"".join(made[o]), np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                else:
                    columns.append(pa.array(made[o], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = kept.mapInArrow(run, schema)
    return out.toDF(*keep, "n_tokens", *outputs)
