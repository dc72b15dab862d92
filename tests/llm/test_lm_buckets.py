"""Packed places of the language model: small files, and buckets of any size that give the same scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeq.llm import lm_score


def test_places_take_few_bytes_and_come_back_whole():
    draw = np.random.default_rng(5)
    codes = np.minimum(draw.zipf(1.3, 3 * 9000), 5002).astype(np.uint32)
    rare = draw.integers(1 << 40, 1 << 60, (codes == 5002).sum(), dtype=np.uint64)
    row, train = np.sort(draw.integers(0, 300, 9000)), draw.random(9000) < 0.8
    packed = lm_score.pack(codes, rare, row, train, 7000)
    assert len(packed) < 9000 * 6 + 8 * len(rare) + 200
    first, second = lm_score.unpack(packed + packed)
    for got in (first, second):
        assert all((a == b).all() for a, b in zip(got, (codes, rare, row + 7000, train)))


def test_size_of_buckets_changes_no_score(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    scores = lambda **k: {r["doc_id"]: r for r in lm_score.score(docs, F.expr("doc_id % 4 <> 1"), **k).collect()}
    whole = scores()
    # many buckets, each read in pieces, with words dealt over several; texts' sums handed on early
    for name, value in (("AT_ONCE", 40), ("HOT", 0.5), ("SUMS", 20), ("PACKED", 2000)):
        monkeypatch.setattr(lm_score, name, value)
    for frequent in (20, 1000):
        small = scores(places=150, frequent=frequent)
        assert small.keys() == whole.keys()
        for i, r in whole.items():
            assert (small[i]["n_tokens"], small[i]["n_known"]) == (r["n_tokens"], r["n_known"])
            assert small[i]["score"] == pytest.approx(r["score"], abs=1e-8)
            assert small[i]["base_score"] == pytest.approx(r["base_score"], abs=1e-8)
