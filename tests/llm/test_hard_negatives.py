"""Hard negatives against comparing everything with everything."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tradeq.llm import hard_negatives as H


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, q, label in usable:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, other) for i, w, other in usable if i != a)
        for s, p, other in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, i) for n, i, o in scored if o != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit[:negatives], start=1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in H.mine(df, lambda i: i % 10 == 0, **options).collect())


def made(seed, n=400, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = []
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=d) * 0.4
        rows.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], int(rng.integers(0, 4)) if i % 3 else i % 8 % 4))
    same = rows[20][1]
    rows += [(n + i, same, i % 2) for i in range(60)]  # ties over many rows
    rows += [(1000, None, 1), (1010, [float("nan")] * d, 1), (1020, [None, *same[1:]], 1), (1030, same, None), (None, same, 2), (1040, [math.inf] * d, 0)]
    return rows


def test_against_all_pairs(spark):
    rows = made(1)
    assert mined(spark, rows, block=16) == brute(rows, lambda a: a % 10 == 0)
    assert mined(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_repeated_rows_other_lengths_and_great_values(spark):
    rng = random.Random(2)
    rows = [(i % 50, [rng.uniform(-1, 1) for _ in range(rng.randint(0, 6))], i % 3) for i in range(70)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = mined(spark, rows, block=8)
    assert got == brute(rows, lambda a: a % 10 == 0)
    great = [(i, [float(np.float32(x * 1e6)) for x in v], c) for i, v, c in made(3, 60, 5)[:60]]
    assert mined(spark, great, block=8) == brute(great, lambda a: a % 10 == 0)


def test_changed_labels_and_no_rows(spark):
    rows = made(4, 100)[:100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = H.mine(df, lambda i: i % 10 == 0, new_label=lambda i, c: F.when(i % 7 == 0, (c + 1) % 10).otherwise(c))
    changed = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(changed, lambda a: a % 10 == 0)
    assert H.mine(df.limit(0), lambda i: i % 10 == 0).collect() == []


def test_zone_maps_spare_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(32)[:16] + 0.3
    rows = [(i, [float(x) for x in np.float32(centres[i % 16] + rng.normal(size=32) * 0.01)], i % 16) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = H._whole(df, 256, "embedding", "label", "vec_id", None)
    blocks = H.Blocks(H.write_blocks(whole, 50))
    total = sum(len(places) for path in blocks.paths for places, *_ in blocks.zones(path))
    ids = np.array([0, 160])
    vectors = np.floor(256 * np.array([rows[i][1] for i in ids]))
    got = sorted(H._answer(blocks, ids, np.array([0, 0], object), vectors, 5, 10, 30, 40))
    assert [tuple(map(int, g)) for g in got] == brute(rows, lambda a: a in (0, 160), high=40)
    assert total == 64 and blocks.read < total / 4


def test_curve_keeps_neighbours_together():
    grid = np.array([(x, y) for x in range(-3, 4, 2) for y in range(-3, 4, 2)], float) * 256 / 3
    order = sorted(range(16), key=H.hilbert_keys(grid).__getitem__)
    walk = grid[order]
    cells = np.unique(walk, axis=0)
    steps = np.abs(np.diff(walk, axis=0)).sum(1)
    assert len(cells) == 16 and len(set(H.hilbert_keys(grid))) == 16 and (steps <= 2 * 256 / 3 + 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (500, 9))
    least, most = H.bounds(a.astype(float), b.min(0)[None], b.max(0)[None])
    score = H.products(a.astype(float), b.astype(float))
    assert (score == a @ b.T).all() and (score >= least).all() and (score <= most).all()
