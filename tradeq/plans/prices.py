"""Queries over the catalogs and stale prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeq.functions.values import csv_ints, csv_of
from tradeq.operators import catalog as C
from tradeq.operators import staleness as S
from tradeq.plans.registry import query
from tradeq.plans.views import using
from tradeq.sources.market import LOG_NOW, NOW, Market

_TRIM = "trim({}, ' '||chr(9)||chr(13)||chr(10)||chr(160))"


def trim(c: str) -> str:
    return _TRIM.format(c)


# ---- catalogs ---------------------------------------------------------------


@query("catalog_scan", using("commodities terminals", """
    SELECT 'commodity' AS entry, id, name FROM commodities WHERE is_visible=1
    UNION ALL
    SELECT 'terminal', id, name FROM terminals WHERE lower(type)='commodity' AND is_visible=1"""))
def catalog_scan(m: Market):
    commodities, terminals = C.load_catalog(m.commodities(), m.terminals())
    pick = lambda df, label: df.select(F.lit(label).alias("entry"), "id", "name")
    return pick(commodities, "commodity").unionByName(pick(terminals, "terminal"))


@query("cargo_vehicles", using("vehicles", """
    SELECT id, name, scu FROM vehicles WHERE is_cargo=1 AND scu>0
    ORDER BY scu DESC, upper(name), id"""))
def cargo_vehicles(m: Market):
    return C.cargo_vehicles(m.vehicles()).select("id", "name", "scu")


@query("snapshot_vintage", using("terminals", """
    SELECT 'terminals' AS snapshot, count(*) AS n_rows,
           count(*)>0 AND bool_and(id_planet=0 AND id_orbit=0 AND id%5=0) AS is_legacy FROM terminals
    UNION ALL
    SELECT 'systems only', count(*), count(*)>0 AND bool_and(id%5=0) FROM terminals
    UNION ALL
    SELECT 'nations', count(*), count(*)>0 AND bool_and(n_nationkey*0=0) FROM nation"""))
def snapshot_vintage(m: Market):
    """All three ids of the hierarchy count; one that is set anywhere makes a snapshot new enough."""
    ids = ["id_planet", "id_orbit", "id_star_system"]
    places = m.terminals().withColumn("id_star_system", (F.col("id") % 5).cast("int"))
    snapshots = {
        "terminals": places,
        "systems only": places.withColumns({"id_planet": F.lit(0), "id_orbit": F.lit(None).cast("int")}),
        "nations": m.table("nation").select(*[(F.col("n_nationkey") * 0).alias(c) for c in ids]),
    }
    parts = [C.is_legacy_snapshot(df, ids).select(F.lit(name).alias("snapshot"), "*") for name, df in snapshots.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PRIMARY = f"""CASE WHEN {trim('name')}='' OR name IS NULL THEN coalesce({trim('displayname')},'')
     WHEN {trim('displayname')}='' OR displayname IS NULL THEN {trim('name')}
     WHEN upper({trim('name')})=upper({trim('displayname')}) THEN {trim('displayname')} ELSE {trim('name')} END"""
_PLACE = "coalesce(" + ",".join(
    f"nullif({trim(c)},'')" for c in ("city_name", "outpost_name", "space_station_name", "planet_name")) + ",'')"
LABEL_VIEWS = {
    "label_parts": f"""SELECT *, {_PRIMARY} AS prim, {_PLACE} AS place_name,
            coalesce({trim('star_system_name')},'') AS sys FROM terminals""",
    "label_parents": f"""SELECT *, CASE WHEN strpos(place_name,' (')>1
            THEN {trim("left(place_name, strpos(place_name,' (')-1)")} ELSE place_name END AS par FROM label_parts""",
    "labelled": """SELECT *, concat_ws(' · ', nullif(prim,''),
            CASE WHEN par<>'' AND upper(par)<>upper(prim) THEN par END,
            CASE WHEN sys<>'' AND upper(sys)<>upper(par) AND upper(sys)<>upper(prim) THEN sys END) AS rich_label
            FROM label_parents""",
}


@query("terminal_labels", using("terminals", "SELECT id, rich_label FROM labelled", LABEL_VIEWS))
def terminal_labels(m: Market):
    return m.terminals().select("id", C.rich_label().alias("rich_label"))


@query("location_labels", using("terminals", f"""
    SELECT id, concat_ws(' / ', {','.join(f"CASE WHEN {trim(c)}<>'' THEN {c} END" for c in
      ('city_name', 'outpost_name', 'space_station_name', 'planet_name', 'star_system_name'))}) AS location_label
    FROM terminals"""))
def location_labels(m: Market):
    return m.terminals().select("id", C.location_label().alias("location_label"))


@query("scope_resolution", using("terminals", """
    SELECT id, requested,
      CASE WHEN requested='PLANET' AND id_planet>0 THEN 'PLANET'
           WHEN requested IN ('PLANET','ORBIT') AND id_orbit>0 THEN 'ORBIT' ELSE 'TERMINAL' END AS scope,
      CASE WHEN requested='PLANET' AND id_planet>0 THEN id_planet
           WHEN requested IN ('PLANET','ORBIT') AND id_orbit>0 THEN id_orbit ELSE id END AS scope_id
    FROM terminals, (SELECT unnest(['TERMINAL','ORBIT','PLANET']) AS requested)"""))
def scope_resolution(m: Market):
    asked = m.terminals().withColumn("requested", F.explode(F.array(*[F.lit(s) for s in C.SCOPES])))
    return asked.select("id", "requested", C.resolve_scope(F.col("requested")).alias("r")).select(
        "id", "requested", "r.scope", "r.scope_id"
    )


_KEYED = {
    "keyed": """SELECT *, upper(CASE WHEN trim(coalesce(displayname,''))<>'' THEN displayname
                WHEN trim(coalesce(name,''))<>'' THEN name END) AS name_key FROM terminals""",
    "ambiguous": """SELECT name_key, count(DISTINCT upper(coalesce(star_system_name,''))) AS n_systems
                FROM keyed WHERE name_key IS NOT NULL GROUP BY 1 HAVING n_systems>=2""",
}


@query("ambiguous_names", using("terminals", "SELECT * FROM ambiguous", _KEYED))
def ambiguous_names(m: Market):
    return C.ambiguous_names(m.terminals())


@query("ambiguous_candidates", using("terminals", """
    SELECT name_key, n_systems, id, coalesce(star_system_name,'') AS star_system,
           row_number() OVER (PARTITION BY name_key ORDER BY coalesce(star_system_name,''), id) AS position
    FROM keyed JOIN ambiguous USING (name_key)""", _KEYED))
def ambiguous_candidates(m: Market):
    from pyspark.sql import Window as W

    w = W.partitionBy("name_key").orderBy("star_system", "id")
    return C.ambiguous_candidates(m.terminals()).withColumn("position", F.row_number().over(w))


@query("container_sets", using("commodities", """
    SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
             string_split(coalesce(container_sizes,''),','), lambda x: TRY_CAST(trim(x) AS INT)), lambda x: x>0))), ',')
             AS sizes FROM commodities"""))
def container_sets(m: Market):
    return m.commodities().select("id", csv_of(csv_ints(F.col("container_sizes"))).alias("sizes"))


# ---- staleness --------------------------------------------------------------


def enriched_targets(m: Market):
    return S.enrich_targets(S.stale_targets(m.prices_all(), NOW), m.terminals())


@query("stale_targets", using("targets", """
    SELECT id_terminal, id_commodity, side, round(last_price,2) AS last_price, days_stale FROM targets"""))
def stale_targets(m: Market):
    return S.stale_targets(m.prices_all(), NOW).select(
        "id_terminal", "id_commodity", "side", F.round("last_price", 2).alias("last_price"), "days_stale"
    )


@query("target_priority", using("targets", """
    SELECT id_terminal, side, count(*) AS n_targets, round(max(priority),6) AS top_priority,
           round(sum(priority),4) AS sum_priority FROM targets GROUP BY 1,2"""))
def target_priority(m: Market):
    return (
        S.stale_targets(m.prices_all(), NOW)
        .groupBy("id_terminal", "side")
        .agg(
            F.count(F.lit(1)).alias("n_targets"),
            F.round(F.max("priority"), 6).alias("top_priority"),
            F.round(F.sum("priority"), 4).alias("sum_priority"),
        )
    )


@query("urgent_prices", using("enriched", """
    SELECT id_terminal, id_commodity, side, star_system, is_reachable, days_stale, round(priority,6) AS priority
    FROM enriched"""))
def urgent_prices(m: Market):
    """All stale prices with where they are, the most urgent first."""
    targets = enriched_targets(m).select(
        "id_terminal", "id_commodity", "side", "star_system", "is_reachable", "days_stale",
        F.round("priority", 6).alias("priority"),
    )
    return S.rank_targets(targets)


@query("target_catalog_join", using("enriched", """
    SELECT star_system, side, is_reachable, count(*) AS n, max(days_stale) AS oldest
    FROM enriched GROUP BY 1,2,3"""))
def target_catalog_join(m: Market):
    return enriched_targets(m).groupBy("star_system", "side", "is_reachable").agg(
        F.count(F.lit(1)).alias("n"), F.max("days_stale").alias("oldest")
    )


@query("empty_catalog_join", using("targets", """
    SELECT side, true AS is_reachable, count(*) AS n FROM targets GROUP BY 1"""))
def empty_catalog_join(m: Market):
    """With no catalog rows every target stays reachable."""
    out = S.enrich_targets(S.stale_targets(m.prices_all(), NOW), m.terminals().filter("id < 0"))
    return out.groupBy("side", "is_reachable").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_targets", using("enriched commodities", """
    SELECT e.id_terminal, e.id_commodity, e.days_stale FROM enriched e
    LEFT JOIN commodities c ON e.id_commodity=c.id
    WHERE is_reachable AND days_stale>=30 AND side<>'SELL'
      AND (contains(lower(terminal_name),'red') OR contains(lower(c.name),'red')
           OR contains(lower(star_system),'red'))"""))
def filtered_targets(m: Market):
    names = m.commodities().select(F.col("id").alias("id_commodity"), F.col("name").alias("commodity_name"))
    named = enriched_targets(m).join(names, "id_commodity", "left")
    kept = S.filter_targets(named, text=" RED ", over30=True, sell=False)
    return kept.select("id_terminal", "id_commodity", "days_stale")


@query("unsubmitted_targets", using("enriched recent", """
    SELECT id_terminal, id_commodity, side, days_stale FROM enriched e
    WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.id_terminal=e.id_terminal AND r.id_commodity=e.id_commodity)"""))
def unsubmitted_targets(m: Market):
    left = S.exclude_recent(enriched_targets(m), S.recent_pairs(m.submissions(), LOG_NOW))
    return left.select("id_terminal", "id_commodity", "side", "days_stale")


STALENESS_VIEWS = {
    "flagged": """SELECT e.*, r.id_terminal IS NOT NULL AS is_recent FROM enriched e
                  LEFT JOIN recent r ON e.id_terminal=r.id_terminal AND e.id_commodity=r.id_commodity
                  WHERE is_reachable""",
    "terminal_stale": """SELECT id_terminal, coalesce(max(days_stale) FILTER (WHERE NOT is_recent),0) AS max_days,
                  count(*) FILTER (WHERE days_stale>=30 AND NOT is_recent) AS stale_count,
                  count(*) FILTER (WHERE days_stale>=30) AS raw_count,
                  count(*) FILTER (WHERE days_stale>=30 AND is_recent) AS excluded_count
                  FROM flagged GROUP BY 1""",
}


@query("terminal_staleness", using("enriched recent", "SELECT * FROM terminal_stale", STALENESS_VIEWS))
def terminal_staleness(m: Market):
    return S.terminal_staleness(enriched_targets(m), S.recent_pairs(m.submissions(), LOG_NOW))
