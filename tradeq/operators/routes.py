"""Trade routes: generation, economics, staleness overlay, filters and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.functions.economics import (
    blended_score,
    days_stale,
    effective_scu,
    eta_seconds,
    margin_percent,
    profit_per_minute,
    roi_percent,
)
from tradeq.operators.staleness import enrich_targets, mark_recent, staleness_by_terminal
from tradeq.session import settle

PILLS = {
    "loading_dock": "has_loading_dock",
    "elevator": "has_freight_elevator",
    "monitored": "is_monitored",
    "space": "is_space_station",
    "ground": "is_on_ground",
    "refuel": "has_refuel",
}

SORTABLE = ["score", "profit", "investment", "scu", "profit_per_minute", "price_margin", "price_roi", "distance"]

ROWS_PER_SALT = 20_000


def latest_prices(observations: DataFrame) -> DataFrame:
    """Newest observation per (terminal, commodity, side); one partial-aggregated shuffle."""
    newest = F.max(F.struct("ts", "price", "stock", "status")).alias("n")
    return observations.groupBy("id_terminal", "id_commodity", "side").agg(newest).select(
        "id_terminal", "id_commodity", "side", "n.ts", "n.price", "n.stock", "n.status"
    )


def build_routes(
    latest: DataFrame,
    origins: DataFrame | None = None,
    carry: tuple[str, ...] = (),
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Every pair buy side x sell side of one commodity at different terminals.

    ``origins`` (id_terminal) restricts the buy side before pairs are made.
    ``carry`` names columns of ``latest`` to keep for both ends, as ``<name>_o``
    and ``<name>_d``; what is known per price row is best joined before the pairs.
    A commodity bought at more than ``rows_per_salt`` places is split: its buy
    rows are dealt over several salts and its sell rows copied to each, so no
    single task has to produce all pairs of a hot commodity.
    """
    priced = latest.filter("price > 0")
    buy = priced.filter("side = 'BUY'")
    if origins is not None:
        buy = buy.join(origins.select("id_terminal").distinct(), "id_terminal", "left_semi")
    sell = priced.filter("side = 'SELL'")
    hot = (
        buy.groupBy("id_commodity")
        .agg(F.count(F.lit(1)).alias("n_buy"))
        .filter(F.col("n_buy") > rows_per_salt)
        .select("id_commodity", F.ceil(F.col("n_buy") / rows_per_salt).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    buy = buy.join(hot, "id_commodity", "left").withColumn("salt", F.pmod(F.xxhash64("id_terminal"), salts).cast("int"))
    sell = sell.join(hot, "id_commodity", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    origin = buy.select(
        "id_commodity",
        "salt",
        F.col("id_terminal").alias("id_origin"),
        F.col("price").alias("price_origin"),
        F.col("stock").alias("scu_origin"),
        F.col("status").alias("status_origin"),
        *[F.col(c).alias(f"{c}_o") for c in carry],
    )
    destination = sell.select(
        "id_commodity",
        "salt",
        F.col("id_terminal").alias("id_destination"),
        F.col("price").alias("price_destination"),
        F.col("stock").alias("scu_destination"),
        F.col("status").alias("status_destination"),
        *[F.col(c).alias(f"{c}_d") for c in carry],
    )
    pairs = origin.join(destination, ["id_commodity", "salt"]).filter("id_origin <> id_destination").drop("salt")
    po, pd = F.col("price_origin"), F.col("price_destination")
    return (
        pairs.withColumn("price_margin", margin_percent(po, pd))
        .withColumn("price_roi", roi_percent(po, pd))
        .withColumn("full_investment", F.col("scu_origin") * po)
    )


def _two_best(sell: DataFrame, keys: list[str], highest: bool, name: str) -> DataFrame:
    """Best sell price per key, where it is, and the best price elsewhere; pruned before the shuffle."""
    price = F.col("price").desc() if highest else F.col("price").asc()
    w = W.partitionBy(*keys).orderBy(price, "id_terminal")
    two = sell.withColumn("place", F.row_number().over(w)).filter("place <= 2")
    first, second = F.col("place") == 1, F.col("place") == 2
    return two.groupBy(*keys).agg(
        F.max(F.when(first, F.col("price"))).alias(f"{name}_price"),
        F.max(F.when(first, F.col("id_terminal"))).alias(f"{name}_at"),
        F.max(F.when(second, F.col("price"))).alias(f"{name}_else"),
    )


def pair_sums(
    buy: DataFrame, sell: DataFrame, sums: tuple[str, ...] = (), keys: tuple[str, ...] = ("id_commodity",), least: bool = False
) -> DataFrame:
    """What the routes of every buy row add up to, without making a route.

    A buy row meets all sell rows of its key but that of its own terminal. So number, sums and
    best price follow from one row per key, less the own sell row; one key may hold any share
    of the rows, as all of it is aggregated before the shuffle. Adds to the columns of ``buy``
    (id_commodity, id_terminal, price ...): ``n_routes`` (more than 0; buy rows without a route
    go), ``sum_price``, ``best_price``, with ``least`` also ``least_price``, and ``sum_<name>``
    of the ``sums`` of the sell rows. A terminal has at most one sell row per key.
    """
    keys = list(keys)
    totals = sell.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("price").alias("price_all"), *[F.sum(c).alias(f"{c}_all") for c in sums]
    )
    per_key = totals.join(_two_best(sell, keys, True, "best"), keys)
    if least:
        per_key = per_key.join(_two_best(sell, keys, False, "least"), keys)
    own = sell.select(*keys, "id_terminal", F.lit(1).alias("n_own"), F.col("price").alias("price_own"), *[F.col(c).alias(f"{c}_own") for c in sums])
    met = buy.join(per_key, keys).join(own, [*keys, "id_terminal"], "left")
    less = lambda c: F.col(f"{c}_all") - F.coalesce(F.col(f"{c}_own"), F.lit(0))
    elsewhere = lambda name: F.when(F.col(f"{name}_at") == F.col("id_terminal"), F.col(f"{name}_else")).otherwise(F.col(f"{name}_price"))
    added = [less("n").alias("n_routes"), less("price").alias("sum_price"), elsewhere("best").alias("best_price")]
    if least:
        added.append(elsewhere("least").alias("least_price"))
    added += [less(c).alias(f"sum_{c}") for c in sums]
    return met.select(*buy.columns, *added).filter("n_routes > 0")


def sides(latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buy and sell rows of a price table that can be part of a route."""
    priced = latest.filter("price > 0")
    return priced.filter("side = 'BUY'").drop("side"), priced.filter("side = 'SELL'").drop("side")


def origin_economics(sums: DataFrame, budget: Column, vehicle: Column | None = None) -> DataFrame:
    """Affordable routes per origin from ``pair_sums``: n, scu, investment, profit, best_profit."""
    price, n = F.col("price"), F.col("n_routes")
    units = effective_scu(F.col("stock"), price, budget, vehicle)
    affordable = sums.filter(effective_scu(F.col("stock"), price, budget) > 0).withColumn("units", units)
    u = F.col("units")
    return affordable.groupBy(F.col("id_terminal").alias("id_origin")).agg(
        F.sum("n_routes").alias("n"),
        F.sum(u * n).alias("scu"),
        F.sum(u * n * price).alias("investment"),
        F.sum(u * (F.col("sum_price") - n * price)).alias("profit"),
        F.max(u * (F.col("best_price") - price)).alias("best_profit"),
    )


def with_places(routes: DataFrame, terminals: DataFrame, columns: list[str]) -> DataFrame:
    """Copy terminal columns to both ends as ``<name>_o`` and ``<name>_d``."""
    for key, end in (("id_origin", "o"), ("id_destination", "d")):
        side = terminals.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        routes = routes.join(side, key, "left")
    return routes


def effective(routes: DataFrame, budget: Column, vehicle: Column | None = None) -> DataFrame:
    """Units, investment and profit under the caps; profit always from the prices."""
    units = effective_scu(F.col("scu_origin"), F.col("price_origin"), budget, vehicle)
    return (
        routes.withColumn("scu", units)
        .withColumn("investment", F.col("scu") * F.col("price_origin"))
        .withColumn("profit", F.col("scu") * (F.col("price_destination") - F.col("price_origin")))
    )


def drop_unaffordable(routes: DataFrame, budget: Column) -> DataFrame:
    """Drop routes without one affordable unit; the vehicle cap plays no part here."""
    return routes.filter(effective_scu(F.col("scu_origin"), F.col("price_origin"), budget) > 0)


def with_eta(routes: DataFrame) -> DataFrame:
    return routes.withColumn("eta_seconds", eta_seconds(F.col("distance"))).withColumn(
        "profit_per_minute", profit_per_minute(F.col("profit"), F.col("eta_seconds"))
    )


STALE_COLUMNS = ("max_days", "stale", "excluded", "this_days")


def stale_sides(prices: DataFrame, terminals: DataFrame, recent: DataFrame, now: int) -> DataFrame:
    """Price rows of both sides with their own and their terminal's staleness; anything missing is 0.

    ``prices`` has one row per (terminal, commodity), so each side is a target at most once and
    its own age needs no join. Routes built with ``carry=STALE_COLUMNS`` then need no join
    at all; there are far fewer price rows than routes.
    """
    side = lambda name, suffix, stock: F.struct(
        F.lit(name).alias("side"), F.col(f"price_{suffix}").alias("price"), F.col(stock).alias("stock"), F.col(f"status_{suffix}").alias("status")
    )
    rows = mark_recent(enrich_targets(prices, terminals), recent).select(
        "id_terminal", "id_commodity", "date_modified", "is_reachable", "is_recent",
        F.inline(F.array(side("BUY", "buy", "scu_buy"), side("SELL", "sell", "scu_sell_stock"))),
    )
    target = F.col("is_reachable") & (F.col("date_modified") > 0)
    aged = rows.filter("price > 0").withColumn("days_stale", days_stale(F.col("date_modified"), F.lit(now)))
    # read for the terminals' sums and again for the rows themselves
    known = settle(aged.withColumn("is_target", target).drop("is_reachable"), "stale-sides")
    per_terminal = staleness_by_terminal(known.filter("is_target")).select(
        "id_terminal", "max_days", F.col("stale_count").alias("stale"), F.col("excluded_count").alias("excluded")
    )
    own = F.when(F.col("is_target") & ~F.col("is_recent"), F.col("days_stale")).otherwise(0)
    return (
        known.withColumn("this_days", own)
        .join(per_terminal, "id_terminal", "left")
        .fillna(0, subset=list(STALE_COLUMNS))
        .select("id_terminal", "id_commodity", "side", F.col("date_modified").alias("ts"), "price", "stock", "status", *STALE_COLUMNS)
    )


def route_ages(routes: DataFrame) -> DataFrame:
    return (
        routes.withColumn("this_route_days", F.greatest("this_days_o", "this_days_d"))
        .withColumn("max_days_any", F.greatest("max_days_o", "max_days_d"))
        .withColumn("total_stale", F.col("stale_o") + F.col("stale_d"))
        .withColumn("excluded_recent", F.col("excluded_o") + F.col("excluded_d"))
    )


def with_score(routes: DataFrame, slider: Column) -> DataFrame:
    return routes.withColumn(
        "score", blended_score(F.col("profit"), F.col("max_days_any"), F.col("total_stale"), slider)
    )


def filter_pills(routes: DataFrame, pills: list[str]) -> DataFrame:
    """Every active pill must hold at origin and destination."""
    both = [F.col(f"{PILLS[p]}_{end}") == 1 for p in pills for end in ("o", "d")]
    return routes.filter(reduce(lambda a, b: a & b, both)) if both else routes


def filter_legal(routes: DataFrame, commodities: DataFrame) -> DataFrame:
    """Drop routes, or price rows, of known illegal commodities; unknown commodities stay."""
    illegal = commodities.filter("is_illegal = 1").select(F.col("id").alias("id_commodity"))
    return routes.join(illegal, "id_commodity", "left_anti")


def with_pills(prices: DataFrame, terminals: DataFrame, pills: list[str]) -> DataFrame:
    """Price rows at terminals that have every active pill: what ``filter_pills`` keeps, before routes are made."""
    if not pills:
        return prices
    fit = terminals.filter(reduce(lambda a, b: a & b, [F.col(PILLS[p]) == 1 for p in pills]))
    return prices.join(fit.select(F.col("id").alias("id_terminal")), "id_terminal", "left_semi")


def filter_predicted(routes: DataFrame) -> DataFrame:
    return routes.filter(~((F.col("user_rows_o") > 0) & (F.col("user_rows_d") > 0)))


def filter_profit(routes: DataFrame, min_profit: float | None = None, min_per_minute: float | None = None) -> DataFrame:
    routes = routes.filter("profit > 0")
    if min_profit and min_profit > 0:
        routes = routes.filter(F.col("profit") >= min_profit)
    if min_per_minute and min_per_minute > 0:
        routes = routes.filter(F.col("profit_per_minute") >= min_per_minute)
    return routes


def container_fits(sets: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Which distinct container set fits which vehicle: (set, id_vehicle).

    ``sets`` has one row per distinct sorted array ``set``; ``vehicles`` has
    ``id_vehicle`` and ``allowed``. Overlap is an equi-join on the size. An
    empty set on either side fits everything and is kept as a null wildcard.
    """
    by_size = (
        sets.select("set", F.explode("set").alias("size"))
        .join(vehicles.select("id_vehicle", F.explode("allowed").alias("size")), "size")
        .select("set", "id_vehicle")
        .distinct()
    )
    any_vehicle = sets.filter(F.size("set") == 0).select("set", F.lit(None).cast("int").alias("id_vehicle"))
    any_set = vehicles.filter(F.size("allowed") == 0).select(
        F.lit(None).cast("array<int>").alias("set"), "id_vehicle"
    )
    return by_size.unionByName(any_vehicle).unionByName(any_set)


def filter_container_fit(routes: DataFrame, vehicle_sizes: Column) -> DataFrame:
    """Keep unless the route's and its vehicle's container sets are non-empty and disjoint."""
    mine = F.col("container_set")
    return routes.filter(
        (F.size(mine) == 0) | (F.size(vehicle_sizes) == 0) | F.arrays_overlap(mine, vehicle_sizes)
    )


SCOPES = ("TERMINAL", "ORBIT", "PLANET")
#: In place of a scope's number where a query names no destination.
ANYWHERE = -(2**63)


def scoped_terminals(terminals: DataFrame) -> DataFrame:
    """(scope, scope_id, id_terminal): each terminal under its own, orbit and planet id."""
    scopes = F.array(
        *[F.struct(F.lit(s).alias("scope"), F.col(c).cast("long").alias("scope_id")) for s, c in zip(SCOPES, ("id", "id_orbit", "id_planet"))]
    )
    return terminals.select(F.col("id").alias("id_terminal"), F.inline(scopes)).filter("scope_id > 0 or scope = 'TERMINAL'")


def _scope_number(scope: str, scope_id: str) -> Column:
    """One number for a scope and its id; null without a known scope."""
    place = F.nullif(F.array_position(F.lit(list(SCOPES)), F.col(scope)), F.lit(0).cast("long"))
    return F.col(scope_id).cast("long") * len(SCOPES) + place - 1


def _starts(terminals: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, origin terminal): a query's origin scope resolved."""
    scoped = scoped_terminals(terminals)
    places = scoped.select(F.col("scope").alias("origin_scope"), F.col("scope_id").alias("origin_id"), F.col("id_terminal").alias("id_origin"))
    return queries.join(places, ["origin_scope", "origin_id"])


def _asks(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is asked, each once with its number ``ask``, and the queries that ask it.

    Both are written, as Spark then knows their sizes: many queries ask the same, and
    ``ask`` stands for all of them until the end.
    """
    ask = ["origin_scope", "origin_id", "want_commodity", "destination_scope", "destination_id"]
    asked = settle(queries.select(*ask).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    other = asked.withColumnsRenamed({c: f"{c}_" for c in ask})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ask])
    return asked, settle(queries.join(other, same).select(*queries.columns, "ask"), "askers")


def routes_for_query(latest: DataFrame, terminals: DataFrame, queries: DataFrame) -> DataFrame:
    """Routes of each query (origin scope, optional commodity, optional destination scope).

    Price rows are cut down to the origins, wanted commodities and destinations of any query
    and meet once per commodity, with the places of both ends; then each route looks up what
    is asked of it. Queries that ask the same are attached to its routes last, so no
    route is shuffled, however many queries want it.
    """
    asked, askers = _asks(queries)
    start = _starts(terminals, asked)
    buy, sell = sides(latest.select("id_terminal", "id_commodity", "side", "price", "stock", "status"))
    opened = start.filter("want_commodity is null").select(F.col("id_origin").alias("id_terminal")).distinct()
    want = F.col("want_commodity").cast(buy.schema["id_commodity"].dataType)
    wanted = start.select(F.col("id_origin").alias("id_terminal"), want.alias("id_commodity")).distinct()
    here = buy.join(opened, "id_terminal", "left_semi").unionByName(
        buy.join(opened, "id_terminal", "left_anti").join(wanted, ["id_terminal", "id_commodity"], "left_semi")
    )
    open_end = F.when(F.col("destination_scope").isNull(), F.lit(ANYWHERE))
    numbered = asked.select(
        "ask", want.alias("want"), _scope_number("origin_scope", "origin_id").alias("from"),
        open_end.otherwise(_scope_number("destination_scope", "destination_id")).alias("to"),
    )
    places = scoped_terminals(terminals).select("id_terminal", _scope_number("scope", "scope_id").alias("number"))
    # three numbers a terminal at most, and one more at all if a query names no destination
    among = lambda c: places.join(numbered.select(F.col(c).alias("number")).distinct(), "number", "left_semi")
    listed = lambda c: among(c).groupBy("id_terminal").agg(F.collect_list("number").alias(c))
    none = F.array().cast("array<long>")
    anywhere = F.when(numbered.agg(F.count_if(F.col("to") == ANYWHERE) > 0).scalar(), F.array(F.lit(ANYWHERE))).otherwise(none)
    there = sell.join(listed("to"), "id_terminal", "left").withColumn("to", F.concat(F.coalesce("to", none), anywhere))
    names = lambda end: {"id_terminal": f"id_{end}", "price": f"price_{end}", "stock": f"scu_{end}", "status": f"status_{end}"}
    pairs = (
        here.join(listed("from"), "id_terminal").withColumnsRenamed(names("origin"))
        .join(there.filter(F.size("to") > 0).withColumnsRenamed(names("destination")), "id_commodity")
        .filter("id_origin <> id_destination")
    )
    met = pairs.withColumn("from", F.explode("from")).withColumn("to", F.explode("to")).join(numbered, ["from", "to"])
    po, pd = F.col("price_origin"), F.col("price_destination")
    return (
        met.filter(F.col("want").isNull() | (F.col("want") == F.col("id_commodity"))).drop("from", "to", "want")
        .join(askers, "ask").drop("ask")
        .withColumn("price_margin", margin_percent(po, pd))
        .withColumn("price_roi", roi_percent(po, pd))
        .withColumn("full_investment", F.col("scu_origin") * po)
    )


def scope_summary(latest: DataFrame, terminals: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query with routes: n, n_origins and best_roi of ``routes_for_query``, without making a route.

    What is asked is summed up once, however many queries ask it, and per origin: a query is met
    by its sums last, so nothing grows with queries times origins. For destinations, each
    commodity has its sums by asked destination in one row, which buy rows look up; they are
    dealt by commodity and as sums by origin, and steps are written so that their shuffles go.
    """
    asked, askers = _asks(queries)
    to = _scope_number("destination_scope", "destination_id")
    start = _starts(terminals, asked).select("ask", "id_origin", "want_commodity", "destination_scope", to.alias("to"))
    buy, sell = sides(settle(latest.filter("price > 0").select("id_terminal", "id_commodity", "side", "price"), "scope-prices"))
    want = F.col("want_commodity").cast(buy.schema["id_commodity"].dataType)
    price, keys = F.col("price"), ["id_terminal", "id_commodity"]

    def summed(routes: DataFrame, *keys: str) -> DataFrame:
        roi = F.max(roi_percent(price, F.col("best_price"))).alias("roi")
        return routes.groupBy(F.col("id_terminal").alias("id_origin"), *keys).agg(F.sum("n_routes").alias("n"), roi)

    open_ended, ends = start.filter("destination_scope is null"), start.filter("to is not null")
    opened, bound = open_ended.filter("want_commodity is null"), ends.filter("want_commodity is null")
    wanted = settle(start.filter("want_commodity is not null").withColumn("id_commodity", want), "scope-wanted")
    of_wanted = lambda rows: rows.join(wanted.select("id_commodity").distinct(), "id_commodity", "left_semi")
    whole = settle(summed(pair_sums(buy, sell)), "scope-whole")
    one = settle(summed(pair_sums(of_wanted(buy), of_wanted(sell)), "id_commodity"), "scope-one")
    places = scoped_terminals(terminals).select("id_terminal", _scope_number("scope", "scope_id").alias("to"))
    places = settle(places.join(asked.select(to.alias("to")).distinct(), "to", "left_semi").distinct(), "scope-places")
    there = sell.join(places, "id_terminal")
    # the few buy rows that are wanted at a destination meet its sell rows themselves
    picked = wanted.filter("to is not null").withColumnRenamed("id_origin", "id_terminal").select(*keys, "to").distinct()
    both = pair_sums(buy.join(picked, keys), of_wanted(there), keys=("id_commodity", "to"))
    parts = [
        opened.join(whole, "id_origin"), wanted.filter("destination_scope is null").join(one, ["id_origin", "id_commodity"]),
        wanted.join(summed(both, "id_commodity", "to"), ["id_origin", "id_commodity", "to"]),
        bound.join(settle(summed(_bound_sums(buy, sell, there, places), "to"), "scope-bound"), ["id_origin", "to"]),
    ]
    found = settle(reduce(DataFrame.unionByName, [x.select("ask", "id_origin", "n", "roi") for x in parts]), "scope-found")
    sums = [F.sum("n").alias("n"), F.count_distinct("id_origin").alias("n_origins"), F.max("roi").alias("best_roi")]
    per_ask = settle(found.groupBy("ask").agg(*sums), "scope-asks")
    # a query id given several times may ask several things: its origins are told apart over all of them
    repeated = askers.groupBy("query_id").count().filter("count > 1").select("query_id")
    once, several = (askers.select("query_id", "ask").join(repeated, "query_id", how) for how in ("left_anti", "left_semi"))
    return once.join(per_ask, "ask").drop("ask").unionByName(several.join(found, "ask").groupBy("query_id").agg(*sums))


def _bound_sums(buy: DataFrame, sell: DataFrame, there: DataFrame, places: DataFrame) -> DataFrame:
    """Like ``pair_sums`` by (id_commodity, to), for buy rows with every asked destination; a commodity's are in one row.

    ``there`` are sell rows under the destinations of their terminal, ``places`` are those of all terminals.
    """
    keys = ["id_commodity", "to"]
    per_key = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(_two_best(there, keys, True, "best"), keys)
    ends = F.collect_list(F.struct("to", "n", "best_price", "best_at", "best_else")).alias("ends")
    ends = settle(per_key.groupBy("id_commodity").agg(ends), "scope-ends")
    own = sell.join(places.groupBy("id_terminal").agg(F.collect_list("to").alias("own")), "id_terminal").select("id_terminal", "id_commodity", "own")
    mine = buy.join(own, ["id_terminal", "id_commodity"], "left")
    met = mine.join(ends, "id_commodity").select("id_terminal", "id_commodity", "price", "own", F.inline("ends"))
    n = F.col("n") - F.coalesce(F.array_contains("own", F.col("to")), F.lit(False)).cast("long")
    best = F.when(F.col("best_at") == F.col("id_terminal"), F.col("best_else")).otherwise(F.col("best_price"))
    return met.select("id_terminal", "id_commodity", "to", "price", n.alias("n_routes"), best.alias("best_price")).filter("n_routes > 0")


def rank_routes(routes: DataFrame, column: str = "score", ascending: bool = False) -> DataFrame:
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column}; choose one of {SORTABLE}")
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return routes.orderBy(key, "id_origin", "id_destination", "id_commodity")


def top_routes(routes: DataFrame, k: int, column: str = "score") -> DataFrame:
    """Best k routes of every origin; Spark prunes each group before the shuffle."""
    w = W.partitionBy("id_origin").orderBy(F.col(column).desc(), "id_destination", "id_commodity")
    return routes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Price steps of sell rows per doubling of the price, for bounds on what a group of them can score.
STEPS = 2


def _scored_end(price_o: Column, units: Column, days_o: Column, stale_o: Column, end: Column, slider: Column) -> Column:
    """Score of a route, or a bound on the scores of several if ``end`` holds the greatest values of their ends."""
    profit = units * (end["price"] - price_o)
    return blended_score(profit, F.greatest(days_o, end["max_days"]), stale_o + end["stale"], slider)


def contenders(ends: DataFrame, k: int, budget: Column, vehicle: Column | None, slider: Column, slack: float = 1e-6) -> DataFrame:
    """Routes among which are the best ``k`` gainful ones of every origin by blended score, and few others.

    ``ends`` are latest prices with ``STALE_COLUMNS``. The score grows with sell price, age and
    stale count of the destination. First every buy row is tried with one or a few of the best
    sell prices of its commodity, which gives each origin a score that k of its routes reach.
    Then sell rows are told in groups by commodity and price step, with the greatest values
    of each: a buy row meets only the rows of groups that can reach its origin's score (less
    ``slack``, for scores compared after rounding) and can gain. Both rounds pass by price rows; no
    commodity is paired with itself as a whole. Columns are those of ``build_routes``.
    """
    buy, sell = sides(ends)
    price = F.col("price")
    units = effective_scu(F.col("stock"), price, budget, vehicle)
    buy = buy.filter(effective_scu(F.col("stock"), price, budget) > 0).withColumn("units", units)
    per_origin = buy.groupBy("id_terminal").agg(F.count(F.lit(1)).alias("n_buy"))
    one = F.struct("price", "max_days", "stale", "id_terminal")
    w = W.partitionBy("id_commodity").orderBy(F.col("price").desc(), "id_terminal")
    top = sell.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    best = top.groupBy("id_commodity").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("end")))).alias("best"))
    step = F.floor(F.log2("price") * STEPS)
    groups = sell.withColumn("step", step).groupBy("id_commodity", "step").agg(
        F.max("price").alias("price"), F.max("max_days").alias("max_days"), F.max("stale").alias("stale")
    )
    # as many groups as price steps at most, whatever the number of rows
    known = groups.groupBy("id_commodity").agg(F.collect_list(F.struct("step", "price", "max_days", "stale")).alias("groups")).join(best, "id_commodity")
    tried = buy.join(per_origin, "id_terminal").join(known, "id_commodity")
    score = lambda end: _scored_end(price, F.col("units"), F.col("max_days"), F.col("stale"), end, slider)
    gains = lambda end: (F.col("units") > 0) & (end["price"] > price)
    others = F.filter("best", lambda b: (b["end"]["id_terminal"] != F.col("id_terminal")) & gains(b["end"]))
    first = F.slice(others, F.lit(1), F.ceil(F.lit(k) / F.col("n_buy")).cast("int"))
    reached = tried.select("id_terminal", F.explode(F.transform(first, lambda b: score(b["end"]))).alias("reached"))
    rank = W.partitionBy("id_terminal").orderBy(F.desc("reached"))
    bar = reached.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).groupBy("id_terminal").agg(
        F.max(F.when(F.col("rank") == k, F.col("reached"))).alias("bar")
    )
    enough = lambda g: gains(g) & (F.col("bar").isNull() | (score(g) >= F.col("bar") - slack))
    asked = tried.drop("best", "n_buy").join(bar, "id_terminal", "left")
    asked = asked.withColumn("step", F.explode(F.transform(F.filter("groups", enough), lambda g: g["step"]))).drop("groups", "bar")
    carried = [c for c in sell.columns if c not in ("id_commodity", "id_terminal", "price", "stock", "status", "ts")]
    names = lambda end, tag: {
        "id_terminal": f"id_{end}", "price": f"price_{end}", "stock": f"scu_{end}", "status": f"status_{end}", **{c: f"{c}_{tag}" for c in carried}
    }
    there = sell.withColumn("step", step).drop("ts").withColumnsRenamed(names("destination", "d"))
    routes = asked.drop("ts", "units").withColumnsRenamed(names("origin", "o")).join(there, ["id_commodity", "step"])
    po, pd = F.col("price_origin"), F.col("price_destination")
    return (
        routes.filter("id_origin <> id_destination").drop("step")
        .withColumn("price_margin", margin_percent(po, pd))
        .withColumn("price_roi", roi_percent(po, pd))
        .withColumn("full_investment", F.col("scu_origin") * po)
    )


def best_destinations(latest: DataFrame, k: int = 1) -> DataFrame:
    """Routes with the k best sell prices for every (origin, commodity), without all pairs.

    For a fixed origin and commodity profit grows with the sell price only, so the
    k+1 best sell rows per commodity hold the answer (one of them may be the origin).
    """
    priced = latest.filter("price > 0")
    best = W.partitionBy("id_commodity").orderBy(F.col("price").desc(), "id_terminal")
    sell = priced.filter("side = 'SELL'").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    pairs = build_routes(priced.filter("side = 'BUY'").unionByName(sell.drop("place")))
    w = W.partitionBy("id_origin", "id_commodity").orderBy(F.col("price_destination").desc(), "id_destination")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
