"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tradeq.llm import phrases


def brute(rows, least=10, shortest=2, longest=3, best=2000, share=50):
    out = []
    by_lang = {}
    for text, lang in rows:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            by_lang.setdefault(lang or "und", []).append(re.findall(r"[^\x20\x09]+", piece))
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        candidates = {p: a for p, a in f.items() if len(p) >= shortest and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(map(len, pieces))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:best], start=1)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "Ärger", "ärger", "x.y", "tab\tbed", "a\x00b", "é"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, weights=[12 if i < 4 else 1 for i in range(len(words))], k=rng.randint(0, 40)))
        rows.append((text.replace("new of", rng.choice(["new york city", "new of", "new,of", "new\nof", "new  of"])), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("..,;", "fr"), ("ha " * 3000, "en"), ("only here", "fr")] + [("same copy of new york city", "en")] * 15


@pytest.mark.parametrize("options", [{}, {"least": 2, "longest": 4, "best": 50}, {"least": 3, "shortest": 3, "share": 90}])
def test_against_counting(spark, options):
    rows = made(len(options))
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    assert got == brute(rows, **options)


def test_many_tasks_and_routes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROUTE_BYTES", 3000)
    monkeypatch.setattr(phrases, "TABLE_BITS", 1 << 12)  # nearly every word is let through
    rows = made(7)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == brute(rows)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_quicksort_counts_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(phrases, "SMALL", 16)  # most partitions are split by pivots
    rng = np.random.default_rng(3)
    n = 4000
    columns, alive = [], np.ones(n, bool)
    for _ in range(3):
        c = rng.zipf(1.4, n) % 40
        alive &= (c != 0) | (len(columns) < 2)
        columns.append(np.where(alive, np.where((c == 0) & (len(columns) < 2), 41, c), 0))
    weights = rng.integers(1, 5, n)
    want = Counter()
    for i in range(n):
        word = [int(c[i]) for c in columns]
        for d in range(1, 3):
            if word[d]:
                want[tuple(word[: d + 1])] += int(weights[i])
    got = {}
    for depth, at, size in phrases.equal_parts(columns, weights, 10):
        for i, s in zip(at, size):
            assert got.setdefault(tuple(int(c[i]) for c in columns[: depth + 1]), int(s)) == s
    assert got == {k: v for k, v in want.items() if v >= 10}
    at, counts = phrases.distinct_suffixes(columns, weights)
    suffixes = Counter()
    for i in range(n):
        suffixes[tuple(int(c[i]) for c in columns)] += int(weights[i])
    assert {tuple(int(c[i]) for c in columns): int(s) for i, s in zip(at, counts)} == suffixes


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT CAST(1000000 AS decimal(7,0)) * (CAST(30000000000000 AS decimal(16,0)) * CAST(30000000000000 AS decimal(16,0)))"
                    " div (CAST(70000000000001 AS decimal(16,0)) * CAST(30000000000007 AS decimal(16,0))) AS s").first()
    assert row.s == 10**6 * 30000000000000**2 // (70000000000001 * 30000000000007)
