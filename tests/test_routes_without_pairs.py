"""Sums, scope summaries and best routes against making every route."""

import random

import pytest
from pyspark.sql import functions as F

from tradeq.operators import routes as R

PRICES = "id_terminal long, id_commodity long, side string, ts long, price double, stock double, status int, max_days int, stale long, excluded long, this_days int"


def prices(rows, seed, commodities=6, terminals=25, hot=None):
    rng = random.Random(seed)
    made = []
    for c in range(commodities):
        for t in range(terminals):
            for side in ("BUY", "SELL"):
                if rng.random() < (0.9 if c == hot and side == "SELL" else 0.4):
                    price = rng.choice([0.0, 10.0, 12.5, rng.uniform(1, 40)])
                    made.append((t, c, side, 5, price, float(rng.randint(0, 300)), rng.randint(0, 7), rng.choice([0, 40, 90, 400]), rng.randint(0, 14), 1, 3))
    return rows(PRICES, *made)


def everything(latest, budget, vehicle):
    routes = R.build_routes(latest, carry=R.STALE_COLUMNS)
    return R.effective(R.drop_unaffordable(routes, budget), budget, vehicle)


@pytest.mark.parametrize("hot", [None, 2])
def test_sums_add_up_all_routes(rows, hot):
    latest, budget, vehicle = prices(rows, 1, hot=hot), F.lit(900.0), F.lit(40.0)
    routes = everything(latest, budget, vehicle).groupBy("id_origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("scu").alias("scu"), F.sum("investment").alias("investment"), F.sum("profit").alias("profit"),
        F.max("profit").alias("best"), F.sum("stale_d").alias("stale"),
    )
    sums = R.pair_sums(*R.sides(latest), R.STALE_COLUMNS)
    got = {r.id_origin: (r.n, r.scu, round(r.investment, 4), round(r.profit, 4), round(r.best_profit, 4)) for r in R.origin_economics(sums, budget, vehicle).collect()}
    assert got == {r.id_origin: (r.n, r.scu, round(r.investment, 4), round(r.profit, 4), round(r.best, 4)) for r in routes.collect()}
    stale = sums.filter(R.effective_scu(F.col("stock"), F.col("price"), budget) > 0).groupBy("id_terminal").agg(F.sum("sum_stale").alias("s"))
    assert {r.id_terminal: r.s for r in stale.collect()} == {r.id_origin: r.stale for r in routes.collect()}


@pytest.mark.parametrize("seed,k,hot", [(2, 3, None), (3, 10, 1), (4, 1, 0), (5, 60, None)])
def test_contenders_hold_the_best_routes(rows, seed, k, hot):
    latest, budget, vehicle, slider = prices(rows, seed, hot=hot), F.lit(3000.0), F.lit(200.0), F.lit(seed * 20.0)

    def best(routes):
        scored = R.filter_profit(R.with_score(R.route_ages(routes), slider)).withColumn("score", F.round("score", 6))
        return {(r.id_origin, r["rank"], r.id_destination, r.id_commodity, r.score) for r in R.top_routes(scored, k).collect()}

    few = R.effective(R.contenders(latest, k, budget, vehicle, slider), budget, vehicle)
    want = everything(latest, budget, vehicle)
    assert best(few) == best(want) and len(best(want)) > 10
    assert few.count() <= want.count() and set(few.columns) == set(want.columns)


def test_a_commodity_hot_on_the_sell_side_is_not_paired_whole(rows):
    hot = [(t, 1, "SELL", 5, 50.0 + t % 7 * 20, 5.0, 1, 10, 1, 0, 0) for t in range(3000)]
    cold = [(t, c, "BUY", 5, 10.0 + c, 100.0, 1, 10, 1, 0, 0) for t in range(3000, 3010) for c in (1, 2, 3)]
    latest = rows(PRICES, *hot, *cold, *[(9000 + c, c, "SELL", 5, 900.0, 5.0, 1, 10, 1, 0, 0) for c in (2, 3)])
    few = R.contenders(latest, 2, F.lit(0.0), None, F.lit(0.0))
    assert few.count() < 100
    assert everything(latest, F.lit(0.0), None).count() == 30_020


def test_scopes(rows):
    latest = prices(rows, 6, hot=3)
    terminals = rows("id long, id_orbit long, id_planet long", *[(t, t % 4, t % 3) for t in range(25)])
    rng = random.Random(7)
    asked = []
    for q in range(60):
        scope = rng.choice(["TERMINAL", "ORBIT", "PLANET"])
        bound = rng.choice([None, "TERMINAL", "ORBIT", "PLANET"])
        asked.append((q, scope, rng.randint(0, 5), rng.choice([None, 1, 3]), bound, rng.randint(0, 4) if bound else None))
    queries = rows("query_id int, origin_scope string, origin_id long, want_commodity long, destination_scope string, destination_id long", *asked)
    under = lambda t, scope, i: {"TERMINAL": t == i, "ORBIT": i > 0 and t % 4 == i, "PLANET": i > 0 and t % 3 == i}[scope]
    want = {}
    for r in R.build_routes(latest).collect():
        for q, scope, i, c, bound, j in asked:
            if under(r.id_origin, scope, i) and c in (None, r.id_commodity) and (bound is None or under(r.id_destination, bound, j)):
                want.setdefault(q, []).append((r.id_origin, r.id_destination, r.id_commodity, r.price_roi))
    got = {}
    for r in R.routes_for_query(latest, terminals, queries).collect():
        got.setdefault(r.query_id, []).append((r.id_origin, r.id_destination, r.id_commodity, r.price_roi))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    told = {r.query_id: (r.n, r.n_origins, r.best_roi) for r in R.scope_summary(latest, terminals, queries).collect()}
    assert told == {q: (len(x), len({o for o, *_ in x}), max(v[-1] for v in x)) for q, x in want.items()}


def test_queries_that_ask_the_same_do_not_multiply_what_is_shuffled(rows, capsys):
    latest = prices(rows, 9)
    terminals = rows("id long, id_orbit long, id_planet long", *[(t, t % 4, t % 3) for t in range(25)])
    same = [(q, "ORBIT", 1, None, "PLANET", 2) for q in range(40)] + [(90, "ORBIT", 1, None, "MOON", 1), (91, "MOON", 1, None, None, None), (92, "ORBIT", 1, None, None, None)]
    queries = rows("query_id int, origin_scope string, origin_id long, want_commodity long, destination_scope string, destination_id long", *same)
    found = R.routes_for_query(latest, terminals, queries)
    found.explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if " Exchange hashpartitioning(" in line]
    assert any("hashpartitioning(id_commodity#" in line for line in dealt)
    assert not any("destination_scope" in line or "destination_id" in line for line in dealt if "id_commodity" in line)
    per = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    every = [(r.id_origin, r.id_destination) for r in R.build_routes(latest).collect() if r.id_origin % 4 == 1]
    bound = sum(d % 3 == 2 for _, d in every)
    assert per == {q: bound for q in range(40)} | {92: len(every)} and bound > 5


def test_pills_before_routes_keep_the_same(rows):
    latest = prices(rows, 8)
    flags = rows("id long, has_refuel int, is_monitored int", *[(t, t % 2, t % 3 % 2) for t in range(25)])
    pills = ["refuel", "monitored"]
    after = R.filter_pills(R.with_places(R.build_routes(latest), flags, [R.PILLS[p] for p in pills]), pills)
    before = R.build_routes(R.with_pills(latest, flags, pills))
    key = lambda d: sorted((r.id_origin, r.id_destination, r.id_commodity) for r in d.collect())
    assert key(before) == key(after) != []
