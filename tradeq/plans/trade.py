"""Route queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.functions.values import csv_ints
from tradeq.operators import catalog as C
from tradeq.operators import routes as R
from tradeq.operators import staleness as S
from tradeq.plans.prices import NOW, STALENESS_VIEWS
from tradeq.plans.registry import query
from tradeq.plans.views import using
from tradeq.session import settle
from tradeq.sources.market import LOG_NOW, Market

BUDGET = 300_000
VEHICLE = 25.0
SLIDER = 40

ROUTE_VIEWS = {
    "latest": "SELECT id_terminal,id_commodity,side,ts,price,stock,status FROM ranked_obs WHERE rn=1 AND price>0",
    "routes": """SELECT b.id_commodity, b.id_terminal AS id_origin, s.id_terminal AS id_destination,
        b.price AS price_origin, b.stock AS scu_origin, b.status AS status_origin,
        s.price AS price_destination, s.stock AS scu_destination, s.status AS status_destination,
        (s.price-b.price)/s.price*100.0 AS price_margin, (s.price-b.price)/b.price*100.0 AS price_roi,
        b.stock*b.price AS full_investment
        FROM latest b JOIN latest s ON b.id_commodity=s.id_commodity AND b.side='BUY' AND s.side='SELL'
             AND b.id_terminal<>s.id_terminal""",
}


def _cap(price: str, *caps: str) -> str:
    vehicle = "".join(f", CAST(floor({c}) AS BIGINT)" for c in caps)
    return (
        f"CASE WHEN floor(scu_origin)<=0 THEN 0 ELSE greatest(0, least(CAST(floor(scu_origin) AS BIGINT), "
        f"CASE WHEN {price}>0 THEN CAST(floor({BUDGET}/{price}) AS BIGINT) END{vehicle})) END"
    )


MONEY_VIEWS = ROUTE_VIEWS | {
    "capped": f"SELECT *, {_cap('price_origin')} AS budget_scu, {_cap('price_origin', str(VEHICLE))} AS scu FROM routes",
    "money": """SELECT *, scu*price_origin AS investment, scu*(price_destination-price_origin) AS profit
        FROM capped WHERE budget_scu>0""",
    "placed": """SELECT m.*, CASE WHEN o.place IS NULL OR d.place IS NULL OR o.place=d.place THEN 0.0
               ELSE abs(o.place-d.place)+1.0 END AS distance
        FROM money m LEFT JOIN terminals o ON id_origin=o.id LEFT JOIN terminals d ON id_destination=d.id""",
    "timed": """SELECT *, CASE WHEN distance>0 THEN distance*1000.0/175.0+10.0 ELSE 0.0 END AS eta_seconds
        FROM placed""",
    "rated": """SELECT *, CASE WHEN eta_seconds>0 THEN profit/(eta_seconds/60.0) ELSE profit END AS profit_per_minute
        FROM timed""",
}

OVERLAY_VIEWS = MONEY_VIEWS | STALENESS_VIEWS | {
    "ages": "SELECT id_terminal,id_commodity,side,max(days_stale) AS days FROM flagged WHERE NOT is_recent GROUP BY 1,2,3",
    "overlaid": """SELECT r.*, coalesce(o.max_days,0) AS max_days_o, coalesce(d.max_days,0) AS max_days_d,
        coalesce(o.stale_count,0) AS stale_o, coalesce(d.stale_count,0) AS stale_d,
        coalesce(o.excluded_count,0)+coalesce(d.excluded_count,0) AS excluded_recent,
        coalesce(ao.days,0) AS this_days_o, coalesce(ad.days,0) AS this_days_d
        FROM rated r LEFT JOIN terminal_stale o ON id_origin=o.id_terminal
        LEFT JOIN terminal_stale d ON id_destination=d.id_terminal
        LEFT JOIN ages ao ON id_origin=ao.id_terminal AND r.id_commodity=ao.id_commodity AND ao.side='BUY'
        LEFT JOIN ages ad ON id_destination=ad.id_terminal AND r.id_commodity=ad.id_commodity AND ad.side='SELL'""",
    "aged": """SELECT *, greatest(this_days_o,this_days_d) AS this_route_days,
        greatest(max_days_o,max_days_d) AS max_days_any, stale_o+stale_d AS total_stale FROM overlaid""",
    "scored": f"""SELECT *, (1.0-{SLIDER}/100.0)*least(1.0,greatest(0.0,profit/5000000.0))
        + {SLIDER}/100.0*(0.7*least(1.0,max_days_any/180.0)+0.3*least(1.0,total_stale/10.0)) AS score FROM aged""",
}

_TRADE = "ranked_obs terminals"
_OVERLAY = "ranked_obs terminals enriched recent"


def routes_of(m: Market) -> DataFrame:
    return R.build_routes(R.latest_prices(m.observations()))


def money_routes(m: Market) -> DataFrame:
    budget, vehicle = F.lit(BUDGET), F.lit(VEHICLE)
    return R.effective(R.drop_unaffordable(routes_of(m), budget), budget, vehicle)


def with_distance(routes: DataFrame) -> DataFrame:
    o, d = F.col("place_o"), F.col("place_d")
    apart = F.when(o.isNull() | d.isNull() | (o == d), 0.0).otherwise(F.abs(o - d) + 1.0)
    return routes.withColumn("distance", apart)


def timed_routes(m: Market) -> DataFrame:
    return R.with_eta(with_distance(R.with_places(money_routes(m), m.terminals(), ["place"])))


def route_ends(m: Market) -> DataFrame:
    """Latest prices with places and staleness; both ends of routes read this table, so it is worked out once."""
    places = m.terminals().select(F.col("id").alias("id_terminal"), "place")
    known = R.stale_sides(m.prices_all(), m.terminals(), S.recent_pairs(m.submissions(), LOG_NOW), NOW)
    return settle(known.join(places, "id_terminal", "left"), "route-ends")


def aged_routes(m: Market, ends: DataFrame | None = None) -> DataFrame:
    """Timed routes with ages; places and staleness are joined to the prices, before pairs are made."""
    routes = R.build_routes(route_ends(m) if ends is None else ends, carry=(*R.STALE_COLUMNS, "place"))
    budget, vehicle = F.lit(BUDGET), F.lit(VEHICLE)
    money = R.effective(R.drop_unaffordable(routes, budget), budget, vehicle)
    return R.route_ages(R.with_eta(with_distance(money)))


def scored_routes(m: Market) -> DataFrame:
    return R.with_score(aged_routes(m), F.lit(SLIDER))


@query("latest_prices", using("ranked_obs", """
    SELECT id_terminal, id_commodity, side, ts, round(price,2) AS price, stock, status FROM ranked_obs WHERE rn=1"""))
def latest_prices(m: Market):
    return R.latest_prices(m.observations()).withColumn("price", F.round("price", 2))


@query("route_pairs", using("ranked_obs", """
    SELECT id_commodity, count(*) AS n_routes, round(max(price_margin),6) AS best_margin,
           round(max(price_roi),6) AS best_roi, round(min(price_margin),6) AS worst_margin,
           round(sum(full_investment),2) AS full_investment FROM routes GROUP BY 1""", ROUTE_VIEWS))
def route_pairs(m: Market):
    """All routes of a commodity in numbers; no route is made for it."""
    sums = R.pair_sums(*R.sides(R.latest_prices(m.observations())), least=True)
    price = F.col("price")
    return sums.groupBy("id_commodity").agg(
        F.sum("n_routes").alias("n_routes"),
        F.round(F.max(R.margin_percent(price, F.col("best_price"))), 6).alias("best_margin"),
        F.round(F.max(R.roi_percent(price, F.col("best_price"))), 6).alias("best_roi"),
        F.round(F.min(R.margin_percent(price, F.col("least_price"))), 6).alias("worst_margin"),
        F.round(F.sum(F.col("n_routes") * F.col("stock") * price), 2).alias("full_investment"),
    )


@query("best_destinations", using("ranked_obs", """
    SELECT id_origin, id_commodity, id_destination, round(price_destination,2) AS price_destination FROM (
      SELECT *, row_number() OVER (PARTITION BY id_origin, id_commodity
                 ORDER BY price_destination DESC, id_destination) AS rank FROM routes) WHERE rank=1""", ROUTE_VIEWS))
def best_destinations(m: Market):
    return R.best_destinations(R.latest_prices(m.observations()), 1).select(
        "id_origin", "id_commodity", "id_destination", F.round("price_destination", 2).alias("price_destination")
    )


_BY_ORIGIN = """SELECT id_origin, count(*) AS n, sum(scu) AS scu, round(sum(investment),2) AS investment,
    round(sum(profit),2) AS profit, round(max(profit),4) AS best_profit"""


def _by_origin(df: DataFrame) -> DataFrame:
    return df.groupBy("id_origin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("scu").alias("scu"),
        F.round(F.sum("investment"), 2).alias("investment"),
        F.round(F.sum("profit"), 2).alias("profit"),
        F.round(F.max("profit"), 4).alias("best_profit"),
    )


def _summed(economics: DataFrame) -> DataFrame:
    """``origin_economics`` in the rounding of ``_BY_ORIGIN``."""
    return economics.select(
        "id_origin", "n", "scu", F.round("investment", 2).alias("investment"), F.round("profit", 2).alias("profit"),
        F.round("best_profit", 4).alias("best_profit"),
    )


def economics_of(prices: DataFrame) -> DataFrame:
    return _summed(R.origin_economics(R.pair_sums(*R.sides(prices)), F.lit(BUDGET), F.lit(VEHICLE)))


@query("effective_economics", using(_TRADE, f"{_BY_ORIGIN} FROM money GROUP BY 1", MONEY_VIEWS))
def effective_economics(m: Market):
    """Stock, budget and vehicle caps on every route, summed per origin."""
    return economics_of(R.latest_prices(m.observations()))


@query("unaffordable_dropped", using("ranked_obs terminals", f"""
    SELECT id_origin, count(*) AS n_routes, count(*) FILTER (WHERE {_cap('price_origin').replace(str(BUDGET), '2500')}>0) AS n_affordable
    FROM routes GROUP BY 1""", ROUTE_VIEWS))
def unaffordable_dropped(m: Market):
    sums = R.pair_sums(*R.sides(R.latest_prices(m.observations())))
    units = R.effective_scu(F.col("stock"), F.col("price"), F.lit(2500))
    return sums.groupBy(F.col("id_terminal").alias("id_origin")).agg(
        F.sum("n_routes").alias("n_routes"), F.sum(F.when(units > 0, F.col("n_routes")).otherwise(0)).alias("n_affordable")
    )


@query("route_eta", using(_TRADE, """
    SELECT id_origin, round(sum(eta_seconds),3) AS eta, round(max(profit_per_minute),4) AS best_per_minute,
           count(*) FILTER (WHERE eta_seconds=0) AS n_same_place FROM rated GROUP BY 1""", MONEY_VIEWS))
def route_eta(m: Market):
    return timed_routes(m).groupBy("id_origin").agg(
        F.round(F.sum("eta_seconds"), 3).alias("eta"),
        F.round(F.max("profit_per_minute"), 4).alias("best_per_minute"),
        F.count_if(F.col("eta_seconds") == 0).alias("n_same_place"),
    )


@query("route_overlay", using(_OVERLAY, """
    SELECT id_origin, sum(max_days_o) AS max_days_o, sum(max_days_d) AS max_days_d, sum(stale_o) AS stale_o,
           sum(stale_d) AS stale_d, sum(excluded_recent) AS excluded, sum(this_days_o) AS this_o,
           sum(this_days_d) AS this_d FROM aged GROUP BY 1""", OVERLAY_VIEWS))
def route_overlay(m: Market):
    """Staleness at both ends of all affordable routes, added up per origin from price rows."""
    buy, sell = R.sides(route_ends(m))
    sums = R.pair_sums(buy, sell, R.STALE_COLUMNS)
    affordable = sums.filter(R.effective_scu(F.col("stock"), F.col("price"), F.lit(BUDGET)) > 0)
    own = lambda c: F.sum(F.col("n_routes") * F.col(c))
    return affordable.groupBy(F.col("id_terminal").alias("id_origin")).agg(
        own("max_days").alias("max_days_o"),
        F.sum("sum_max_days").alias("max_days_d"),
        own("stale").alias("stale_o"),
        F.sum("sum_stale").alias("stale_d"),
        (own("excluded") + F.sum("sum_excluded")).alias("excluded"),
        own("this_days").alias("this_o"),
        F.sum("sum_this_days").alias("this_d"),
    )


@query("route_ages", using(_OVERLAY, """
    SELECT id_destination, this_route_days//365 AS route_years, max_days_any//365 AS any_years, count(*) AS n,
           sum(total_stale) AS total_stale FROM aged GROUP BY 1,2,3""", OVERLAY_VIEWS))
def route_ages(m: Market):
    laid = aged_routes(m)
    years = lambda c: F.floor(F.col(c) / 365)
    return laid.groupBy(
        "id_destination", years("this_route_days").alias("route_years"), years("max_days_any").alias("any_years")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("total_stale").alias("total_stale"))


@query("blended_scores", using(_OVERLAY, """
    SELECT id_origin, round(sum(score),4) AS sum_score, round(max(score),6) AS best_score FROM scored GROUP BY 1""",
    OVERLAY_VIEWS))
def blended_scores(m: Market):
    return scored_routes(m).groupBy("id_origin").agg(
        F.round(F.sum("score"), 4).alias("sum_score"), F.round(F.max("score"), 6).alias("best_score")
    )


@query("score_by_slider", using(_OVERLAY, """
    SELECT slider, round(sum((1.0-w)*least(1.0,greatest(0.0,profit/5000000.0))
        + w*(0.7*least(1.0,max_days_any/180.0)+0.3*least(1.0,total_stale/10.0))),3) AS sum_score
    FROM aged JOIN (SELECT slider, greatest(0.0,least(1.0,slider/100.0)) AS w
                    FROM (SELECT unnest([-10,0,40,100,150]) AS slider)) ON true GROUP BY 1""", OVERLAY_VIEWS))
def score_by_slider(m: Market):
    """The same routes under several weights at once; the weight is a column."""
    laid = aged_routes(m)
    sliders = F.explode(F.array(*[F.lit(s) for s in (-10, 0, 40, 100, 150)]))
    scored = R.with_score(laid.select("profit", "max_days_any", "total_stale", sliders.alias("slider")), F.col("slider"))
    return scored.groupBy("slider").agg(F.round(F.sum("score"), 3).alias("sum_score"))


@query("pill_filter", using(_TRADE, f"""{_BY_ORIGIN} FROM money m JOIN terminals o ON id_origin=o.id
    JOIN terminals d ON id_destination=d.id
    WHERE o.has_loading_dock=1 AND d.has_loading_dock=1 AND o.has_refuel=1 AND d.has_refuel=1
      AND o.is_monitored=1 AND d.is_monitored=1 GROUP BY 1""", MONEY_VIEWS))
def pill_filter(m: Market):
    """Pills hold at both ends, so price rows at other terminals go before anything else."""
    return economics_of(R.with_pills(R.latest_prices(m.observations()), m.terminals(), ["loading_dock", "refuel", "monitored"]))


@query("legal_filter", using("ranked_obs terminals commodities", f"""{_BY_ORIGIN} FROM money m
    WHERE NOT EXISTS (SELECT 1 FROM commodities c WHERE c.id=m.id_commodity AND is_illegal=1) GROUP BY 1""", MONEY_VIEWS))
def legal_filter(m: Market):
    return economics_of(R.filter_legal(R.latest_prices(m.observations()), m.commodities()))


@query("predicted_filter", using(_TRADE, f"""{_BY_ORIGIN} FROM money
    WHERE NOT (status_origin>2 AND status_destination>3) GROUP BY 1""", MONEY_VIEWS))
def predicted_filter(m: Market):
    """User rows stand in as status minus 2 and 3, so that zeros occur on both sides."""
    buy, sell = R.sides(R.latest_prices(m.observations()))
    # a route stays if its origin has no user rows, or else its destination has none
    sums = R.pair_sums(buy.filter("status <= 2"), sell).unionByName(R.pair_sums(buy.filter("status > 2"), sell.filter("status <= 3")))
    return _summed(R.origin_economics(sums, F.lit(BUDGET), F.lit(VEHICLE)))


@query("predicted_routes", using(_TRADE, """
    SELECT id_commodity, count(*) AS n FROM money WHERE NOT (status_origin>2 AND status_destination>3) GROUP BY 1""", MONEY_VIEWS))
def predicted_routes(m: Market):
    """The same filter on routes themselves."""
    known = money_routes(m).withColumns(
        {"user_rows_o": F.greatest(F.lit(0), F.col("status_origin") - 2),
         "user_rows_d": F.greatest(F.lit(0), F.col("status_destination") - 3)}
    )
    return R.filter_predicted(known).groupBy("id_commodity").agg(F.count(F.lit(1)).alias("n"))


@query("profit_filter", using(_TRADE, f"""{_BY_ORIGIN} FROM rated
    WHERE profit>0 AND profit>=1000 AND profit_per_minute>=200 GROUP BY 1""", MONEY_VIEWS))
def profit_filter(m: Market):
    return _by_origin(R.filter_profit(timed_routes(m), 1000, 200))


_SETS = {
    "csets": """SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(container_sizes,''),','),
             lambda x: TRY_CAST(trim(x) AS INT)), lambda x: x>0))) AS s FROM commodities""",
    "vsets": """SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(container_sizes,''),','),
             lambda x: TRY_CAST(trim(x) AS INT)), lambda x: x>0))) AS v FROM vehicles WHERE is_cargo=1 AND scu>0""",
    "per_set": "SELECT s, count(*) AS n FROM routes JOIN csets ON id_commodity=csets.id GROUP BY 1",
}


@query("container_fit", using("ranked_obs commodities vehicles", """
    SELECT vsets.id AS id_vehicle, sum(n) AS n_routes FROM vsets JOIN per_set
      ON len(s)=0 OR len(v)=0 OR list_has_any(s, v) GROUP BY 1""", ROUTE_VIEWS | _SETS))
def container_fit(m: Market):
    """Routes that fit each vehicle, counted by distinct container set.

    Routes meet vehicles only as a handful of distinct sets, so no routes x
    vehicles product is ever made.
    """
    sets = m.commodities().select(F.col("id").alias("id_commodity"), csv_ints(F.col("container_sizes")).alias("set"))
    sums = R.pair_sums(*R.sides(R.latest_prices(m.observations())))
    per_set = sums.join(sets, "id_commodity").groupBy("set").agg(F.sum("n_routes").alias("n"))
    vehicles = C.cargo_vehicles(m.vehicles()).select(
        F.col("id").alias("id_vehicle"), csv_ints(F.col("container_sizes")).alias("allowed")
    )
    fits = R.container_fits(per_set.select("set"), vehicles)
    exact = fits.filter("set is not null and id_vehicle is not null")
    by_set = per_set.join(exact, "set").groupBy("id_vehicle").agg(F.sum("n").alias("fit"))
    totals = per_set.agg(
        F.sum("n").alias("everything"), F.coalesce(F.sum(F.when(F.size("set") == 0, F.col("n"))), F.lit(0)).alias("open")
    )
    every, opened = totals.select("everything").scalar(), totals.select("open").scalar()
    n = F.when(F.size("allowed") == 0, every).otherwise(F.coalesce("fit", F.lit(0)) + opened)
    return (
        vehicles.join(by_set, "id_vehicle", "left")
        .select("id_vehicle", n.alias("n_routes"))
        .filter("n_routes > 0")
    )


@query("container_filter", using("ranked_obs terminals commodities", f"""{_BY_ORIGIN}
    FROM money JOIN csets ON id_commodity=csets.id WHERE len(s)=0 OR list_has_any(s,[1,2]) GROUP BY 1""",
    MONEY_VIEWS | {"csets": _SETS["csets"]}))
def container_filter(m: Market):
    """One chosen vehicle, as in the interactive filter."""
    sets = m.commodities().select(F.col("id").alias("id_commodity"), csv_ints(F.col("container_sizes")).alias("container_set"))
    fitting = R.filter_container_fit(R.latest_prices(m.observations()).join(sets, "id_commodity"), F.array(F.lit(1), F.lit(2)))
    return economics_of(fitting.drop("container_set"))


_SCOPED = {
    "scoped": """SELECT id AS id_terminal, 'TERMINAL' AS scope, id AS scope_id FROM terminals
       UNION ALL SELECT id, 'ORBIT', id_orbit FROM terminals WHERE id_orbit>0
       UNION ALL SELECT id, 'PLANET', id_planet FROM terminals WHERE id_planet>0""",
    "asked": """SELECT s_suppkey AS query_id, CASE s_suppkey%3 WHEN 0 THEN 'TERMINAL' WHEN 1 THEN 'ORBIT' ELSE 'PLANET' END
         AS origin_scope, CASE s_suppkey%3 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey%7 ELSE s_nationkey END AS origin_id,
         CASE WHEN s_suppkey%2=0 THEN s_suppkey%200 END AS want_commodity,
         CASE s_suppkey%4 WHEN 1 THEN 'PLANET' WHEN 3 THEN 'ORBIT' END AS destination_scope,
         CASE s_suppkey%4 WHEN 1 THEN (s_nationkey+3)%25 WHEN 3 THEN 2 END AS destination_id FROM supplier""",
}


def scope_queries(m: Market) -> DataFrame:
    """One query per supplier, over all scopes, with and without commodity and destination."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    asked = m.table("supplier").select(
        k.alias("query_id"),
        F.when(k % 3 == 0, "TERMINAL").when(k % 3 == 1, "ORBIT").otherwise("PLANET").alias("origin_scope"),
        F.when(k % 3 == 0, k).when(k % 3 == 1, k % 7).otherwise(n).alias("origin_id"),
        F.when(k % 2 == 0, k % 200).alias("want_commodity"),
        F.when(k % 4 == 1, "PLANET").when(k % 4 == 3, "ORBIT").alias("destination_scope"),
        F.when(k % 4 == 1, (n + 3) % 25).when(k % 4 == 3, F.lit(2)).alias("destination_id"),
    )
    return asked


@query("scoped_routes", using("ranked_obs terminals", """
    SELECT query_id, count(*) AS n, count(DISTINCT id_origin) AS n_origins, round(max(price_roi),6) AS best_roi
    FROM asked JOIN scoped o ON o.scope=origin_scope AND o.scope_id=origin_id
    JOIN routes r ON r.id_origin=o.id_terminal AND (want_commodity IS NULL OR want_commodity=r.id_commodity)
    WHERE destination_scope IS NULL OR EXISTS (SELECT 1 FROM scoped d WHERE d.scope=destination_scope
        AND d.scope_id=destination_id AND d.id_terminal=r.id_destination)
    GROUP BY 1""", ROUTE_VIEWS | _SCOPED))
def scoped_routes(m: Market):
    found = R.scope_summary(R.latest_prices(m.observations()), m.terminals(), scope_queries(m))
    return found.select("query_id", "n", "n_origins", F.round("best_roi", 6).alias("best_roi"))


@query("bound_routes", using("ranked_obs terminals", """
    SELECT query_id, id_origin, id_destination, r.id_commodity, round(price_roi,6) AS price_roi
    FROM (SELECT * FROM asked WHERE destination_scope IS NOT NULL) JOIN scoped o ON o.scope=origin_scope AND o.scope_id=origin_id
    JOIN routes r ON r.id_origin=o.id_terminal AND (want_commodity IS NULL OR want_commodity=r.id_commodity)
    JOIN scoped d ON d.scope=destination_scope AND d.scope_id=destination_id AND d.id_terminal=r.id_destination
    WHERE price_roi>0""", ROUTE_VIEWS | _SCOPED))
def bound_routes(m: Market):
    """Gainful routes of the queries that name a destination."""
    asked = scope_queries(m).filter("destination_scope is not null")
    hits = R.routes_for_query(R.latest_prices(m.observations()), m.terminals(), asked).filter("price_roi > 0")
    return hits.select("query_id", "id_origin", "id_destination", "id_commodity", F.round("price_roi", 6).alias("price_roi"))


_ROUTE_OUT = ["id_origin", "id_destination", "id_commodity", "scu", "this_route_days"]


@query("ranked_routes", using(_OVERLAY, """
    SELECT id_origin, id_destination, id_commodity, scu, this_route_days, round(score+1e-9,6) AS score FROM scored
    WHERE profit>0""", OVERLAY_VIEWS))
def ranked_routes(m: Market):
    # many scores end in exactly half a digit: moved off it, both engines round alike
    kept = R.filter_profit(scored_routes(m)).withColumn("score", F.round(F.col("score") + 1e-9, 6))
    return R.rank_routes(kept).select(*_ROUTE_OUT, "score")


@query("top_routes", using("ranked_obs terminals enriched recent commodities", """
    SELECT id_origin, rank, id_destination, id_commodity, scu, this_route_days, score, round(profit,4) AS profit FROM (
      SELECT *, row_number() OVER (PARTITION BY id_origin ORDER BY score DESC, id_destination, id_commodity) AS rank
      FROM (SELECT * REPLACE (round(score,6) AS score) FROM scored WHERE profit>0
        AND NOT EXISTS (SELECT 1 FROM commodities c WHERE c.id=scored.id_commodity AND is_illegal=1)))
    WHERE rank<=10""", OVERLAY_VIEWS))
def top_routes(m: Market):
    """Flagship: ten best legal routes of every origin under budget, vehicle and staleness."""
    budget, vehicle, slider = F.lit(BUDGET), F.lit(VEHICLE), F.lit(SLIDER)
    ends = R.filter_legal(route_ends(m), m.commodities())
    routes = R.effective(R.contenders(ends, 10, budget, vehicle, slider), budget, vehicle)
    kept = R.filter_profit(R.with_score(R.route_ages(routes), slider)).withColumn("score", F.round("score", 6))
    return R.top_routes(kept, 10).select("rank", *_ROUTE_OUT, "score", F.round("profit", 4).alias("profit"))
