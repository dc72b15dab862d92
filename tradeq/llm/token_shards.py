"""Token ids of documents in files, each a wavelet matrix (``wavelet``), and jobs that ask the files.

Spark puts the documents in order of their ids by ranges; every task encodes its range and
writes files of about ``SHARD_TOKENS`` ids, whole documents only, to a folder that all
executors reach. A file's name tells range and place, its content follows from the rows,
so a repeated task replaces it with the same bytes. The manifest (one row a file) is an
ordinary table. Where a range starts is a running sum over one row per range.

Null texts count as empty: such a document has the end id alone. Null ids come first. Rows
that repeat an id stand next to each other, in order of their texts; equal rows give equal
rows. A text longer than a file makes a file of its own. Other columns of the input are
ignored. A table without rows gives a folder without files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from tokenizers import Tokenizer, pre_tokenizers

from tradeq.llm import shared_files
from tradeq.llm.bpe import share
from tradeq.llm.common import slices
from tradeq.llm.wavelet import Matrix, pack
from tradeq.session import settle, shared_dir

SHARD_TOKENS = 1 << 21
#: Pieces from which a worker starts a new generation of its memory; the one before is kept, older ones go.
REMEMBERED = 250_000
# Fixed value: the split rule of a vocabulary whose tokens never hold or span white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
#: Text that normalizing only lowers, one character by one: ASCII, letters of Western languages, common marks.
PLAIN = r"^[\x00-\x08\x0e-\x7fÀ-ÖØ-öø-ÿ¡§«·»¿–—‘’“”„…•]*$"
#: The split rule for such text in lower case and without white space.
PLAIN_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


def _gather(flat: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (``length`` tells where each ends) in the order of ``code``."""
    n = length[code]
    ends = np.cumsum(n)
    first = (np.cumsum(length) - length)[code]
    return flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """The tokenizers library over many texts.

    Where the file's split rule removes white space, pieces between blanks are encoded
    alone and remembered; otherwise whole texts are. Plain pieces are lowered and split by
    the file's rule here, so that the library's model sees each distinct part once; all
    other pieces, and those that may hold a special string, go through the library whole.
    """

    def __init__(self, raw: bytes):
        self.library = Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(raw)
        rules = spec.get("pre_tokenizer") or {}
        first = rules.get("pretokenizers", [rules])[0]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.by_piece = (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
            and first["pattern"].get("Regex") == WORD_SPLIT and [s["type"] for s in steps] == WORD_STEPS
        )
        model = spec["model"]
        if self.by_piece:
            suffix = model["end_of_word_suffix"]
            self.parts_only = Tokenizer.from_str(raw.decode())
            self.parts_only.normalizer = None
            self.parts_only.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)  # tokens that end a part
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.marked = any("<|" not in t["content"] for t in spec["added_tokens"])
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def __call__(self, whole: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        whole = whole.fill_null("")
        if not self.by_piece:
            found = [e.ids for e in self.library.encode_batch_fast(whole.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)
        for blank in "\n\t\r":
            whole = pc.replace_substring(whole, blank, " ")
        split = pc.split_pattern(whole, " ")
        coded = split.flatten().dictionary_encode()
        flat, length = self._pieces(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(length[code])])
        sizes = split.value_lengths().to_numpy(zero_copy_only=False)
        return _gather(flat, length, code), np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and how many each has."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        if self.marked:
            plain = pc.and_(plain, pa.scalar(False))
        plain = pc.and_(plain, pc.invert(pc.match_substring(pieces, "<|")))
        parts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), PLAIN_SPLIT, r"\1 "), " ")
        coded = parts.flatten().dictionary_encode()
        flat, length = self._known(coded.dictionary.to_pylist(), self._parts)
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids = _gather(flat, length, code)
        ends = np.concatenate([[0], np.cumsum(length[code])])
        mine = np.diff(ends[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])])
        other, n_other = self._known(pieces.filter(pc.invert(plain)).to_pylist(), lambda new: self._encoded(self.library, new))
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(mask), np.int64)
        place[mask], place[~mask] = np.arange(len(mine)), len(mine) + np.arange(len(n_other))
        both = np.concatenate([mine, n_other])
        return _gather(np.concatenate([ids, other]), both, place), both[place]

    def _known(self, strings: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, remembered or by ``encode``, and how many each has."""
        found = list(map(self.young.get, strings))
        if None in found:
            late = {p: self.old.get(p) for p, f in zip(strings, found) if f is None}
            new = [p for p, f in late.items() if f is None]
            late.update(zip(new, encode(new)))
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {"": b""}
            self.young.update(late)
            found = [late[p] if f is None else f for p, f in zip(strings, found)]
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def _parts(self, new: list[str]) -> list[bytes]:
        """Packed ids of lowered parts by the library's model, all in one string."""
        if not new:
            return []
        ids = np.array(self.parts_only.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int32)
        edges = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    @staticmethod
    def _encoded(library: Tokenizer, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        done = library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, np.int32).tobytes()
        edges = (np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(pieces) + 1)) * 4).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


@dataclass
class Shards:
    """A folder of files and its manifest (part, shard, first, n_docs, n_tokens, path)."""

    folder: str
    manifest: DataFrame
    id_type: T.DataType


MANIFEST = "part int, shard int, first long, n_docs long, n_tokens long, path string"


def write(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> Shards:
    """Encode every whole text with the tokenizer file ``path``, add ``end_id`` to each, and write all ids in order of ``key``."""
    shared = share(docs, path)
    folder = shared_files.make_folder(shared_dir(docs.sparkSession, "token-shards"))
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared)
        part = TaskContext.get().partitionId()
        done, shard = 0, 0
        held: list[tuple] = []  # (ids of documents, their numbers of tokens, token ids)
        waiting = 0

        def finish() -> pa.RecordBatch:
            nonlocal done, shard, held, waiting
            keys = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            documents = pa.RecordBatch.from_arrays([keys, pa.array(counts)], names=["doc_id", "n_tokens"])
            name = f"{folder}/part-{part:06d}-{shard:06d}.wave"
            shared_files.write_whole(name, pack(ids, documents))
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "shard": shard, "first": done, "n_docs": len(counts), "n_tokens": len(ids), "path": name}],
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), *[(c, pa.int64()) for c in ("first", "n_docs", "n_tokens")], ("path", pa.string())]),
            )
            done, shard, held, waiting = done + len(ids), shard + 1, [], 0
            return row

        for batch in slices(batches, "t"):
            ids, counts = encode(batch.column("t"))
            ids = np.insert(ids, np.cumsum(counts), end_id)  # after the last id of each
            counts = counts + 1
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):
                # documents up to the one that fills the file
                taken = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, taken + shard_tokens - waiting)) + 1
                to = min(to, len(counts))
                held.append((batch.column("k").slice(at, to - at), counts[at:to], ids[taken : int(ends[to - 1])]))
                waiting += int(ends[to - 1]) - taken
                at = to
                if waiting >= shard_tokens:
                    yield finish()
        if held:
            yield finish()

    return Shards(folder, settle(ordered.mapInArrow(run, MANIFEST), "token-manifest"), docs.schema[key].dataType)


def read(spark: SparkSession, shards: Shards, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the checksum of
    its ids as unsigned 32-bit numbers, lowest byte first.
    """
    # one row per range of the writing job, whatever the number of files
    per_part = shards.manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_part.select("part", before.alias("offset"))
    fields = [T.StructField("doc_id", shards.id_type), T.StructField("path", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("within", "n_tokens", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                file = Matrix(content.as_buffer().to_pybytes())
                documents, ids = file.documents(), file.ids().astype("<u4")
                counts = documents.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [documents.column("doc_id"), pa.array([name] * len(counts), pa.string()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wave").load(shards.folder)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = found.select(name(F.col("path")).alias("name"), "content").mapInArrow(run, schema)
    place = shards.manifest.join(offsets, "part").select(name(F.col("path")).alias("path"), (F.col("offset") + F.col("first")).alias("first"))
    kept = ["ids"] if with_ids else []
    return rows.join(place, "path").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *kept)


def _ask(shards: Shards, schema: str | T.StructType, answer) -> DataFrame:
    """One task row per file; ``answer(matrix)`` reads only the blocks it needs and gives columns."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, plain = shared_files.place(path)
                with system.open_input_file(plain) as f:
                    yield pa.RecordBatch.from_arrays(answer(Matrix(f)), names=schema.names)

    parts = shards.manifest.sparkSession.sparkContext.defaultParallelism
    return shards.manifest.select("path").repartition(parts).mapInArrow(run, schema)


def count_ids(shards: Shards, tokens: list[int]) -> DataFrame:
    """How often each asked id occurs in all files (token, n); 0 where it does not."""
    tokens = sorted(set(tokens))

    def answer(file: Matrix):
        return [pa.array(tokens, pa.int32()), pa.array([file.count(t) for t in tokens], pa.int64())]

    return _ask(shards, "token int, n long", answer).groupBy("token").agg(F.sum("n").alias("n"))


def find_id(shards: Shards, token: int) -> DataFrame:
    """Every occurrence of an id: doc_id and place in that document, from 0."""
    schema = T.StructType([T.StructField("doc_id", shards.id_type), T.StructField("place", T.LongType())])

    def answer(file: Matrix):
        at = np.array(file.occurrences(token), np.int64)
        documents = file.documents()
        ends = np.cumsum(documents.column("n_tokens").to_numpy())
        doc = np.searchsorted(ends, at, side="right")
        return [documents.column("doc_id").take(pa.array(doc)), pa.array(at - (ends - documents.column("n_tokens").to_numpy())[doc])]

    return _ask(shards, schema, answer)
