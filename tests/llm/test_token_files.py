"""Files of token ids: the wavelet matrix against plain arrays, the jobs against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tradeq.llm import token_shards, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


def matrix(ids):
    return wavelet.Matrix(wavelet.pack(np.array(ids, np.int64), pa.RecordBatch.from_pydict({"doc_id": [1], "n_tokens": [len(ids)]})))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), max_size=120))
def test_matrix_answers_like_the_array(ids):
    m = matrix(ids)
    assert m.ids().tolist() == ids
    assert [m.access(i) for i in range(len(ids))] == ids
    for token in {*ids[:5], 0, 2, 70_001, 1 << 40}:
        places = [i for i, t in enumerate(ids) if t == token]
        assert m.occurrences(token) == places
        assert m.count(token, 3, 50) == sum(3 <= p < 50 for p in places)


def test_questions_across_blocks():
    ids = np.random.default_rng(1).zipf(1.3, 150_000) % 50_000
    m = matrix(ids)
    assert (m.ids() == ids).all()
    for token in (1, 2, 977, 49_999):
        assert m.occurrences(token)[-50:] == np.flatnonzero(ids == token).tolist()[-50:]
    assert [m.access(i) for i in (0, 32_767, 32_768, 149_999)] == ids[[0, 32_767, 32_768, 149_999]].tolist()
    with pytest.raises(IndexError):
        m.select(1, m.count(1))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        raw = f.read()
    library, encode = Tokenizer.from_str(raw.decode()), token_shards.Encoder(raw)
    texts = ["", " ", "Hello  World", "a\x1cb\x85c　d", "x<|endoftext|>y <|endoftext|>", "ẞ İ Σας é ́x", "tab\tline\nend\r", "12 $%&'ll don't", "Ça—où «Größe» ÿÀ×÷ª²µ", "İıſK", "a" + "\U00010d50" + "B 1", "\u1c89 \ua7cb"]
    for _ in range(2):  # the second time from memory
        ids, n = encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def expected(rows, end_id=2):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_written_and_read_back(spark):
    rows = [(i * 7 % 100, f"Document {i} says\n" + "word " * (i % 9)) for i in range(100)]
    rows += [(200, None), (201, ""), (None, "no id"), (3, "same id"), (300, "long " * 20_000), (300, "long " * 20_000)]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, path string, part int").repartition(7)
    shards = token_shards.write(docs, PATH, 2, shard_tokens=500)
    assert shards.manifest.count() >= 3
    got = [tuple(r) for r in token_shards.read(spark, shards).collect()]
    order = lambda r: r[1]
    assert sorted(got, key=order) == expected(rows)
    whole = token_shards.read(spark, shards, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in whole)
    ends = {r.token: r.n for r in token_shards.count_ids(shards, [2, 49_000]).collect()}
    assert ends[2] == len(rows)
    found = {tuple(r) for r in token_shards.find_id(shards, 2).collect()}
    assert found == {(r.doc_id, r.n_tokens - 1) for r in whole}
    shown = next(t for r in whole if r.doc_id == 49 for t in r.ids)
    places = sorted((r.doc_id if r.doc_id is not None else -1, i) for r in whole for i, t in enumerate(r.ids) if t == shown)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.place) for r in token_shards.find_id(shards, shown).collect()) == places


def test_text_ids_and_no_rows(spark):
    shards = token_shards.write(spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string"), PATH, 2)
    assert [r.doc_id for r in token_shards.read(spark, shards).orderBy("start").collect()] == ["a", "b"]
    empty = token_shards.write(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert token_shards.read(spark, empty).collect() == [] and token_shards.find_id(empty, 2).collect() == []
