"""Reference data: commodities, terminals, vehicles, labels and ambiguous names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.functions.text import blank_to_null, strip
from tradeq.functions.values import csv_ints

PARENT_FIELDS = ["city_name", "outpost_name", "space_station_name", "planet_name"]
SCOPES = ["TERMINAL", "ORBIT", "PLANET"]


def load_catalog(commodities: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible commodities, and visible terminals that trade commodities."""
    return (
        commodities.filter(F.col("is_visible") == 1),
        terminals.filter((F.lower("type") == "commodity") & (F.col("is_visible") == 1)),
    )


def cargo_vehicles(vehicles: DataFrame) -> DataFrame:
    """Vehicles that carry cargo, largest first, then by name ignoring case."""
    return (
        vehicles.filter((F.col("is_cargo") == 1) & (F.col("scu") > 0))
        .orderBy(F.col("scu").desc(), F.upper("name"), "id")
    )


def is_legacy_snapshot(terminals: DataFrame, ids: list[str]) -> DataFrame:
    """One row: true iff the snapshot has rows and every hierarchy id is 0 in all of them."""
    all_zero = F.bool_and(F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0))) for c in ids]) == 0)
    return terminals.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(all_zero, F.lit(False)).alias("is_legacy"))


def location_label() -> Column:
    parts = ["city_name", "outpost_name", "space_station_name", "planet_name", "star_system_name"]
    # blank parts are dropped, kept parts are shown as they are
    return F.concat_ws(" / ", *[F.when(blank_to_null(F.col(c)).isNotNull(), F.col(c)) for c in parts])


def rich_label() -> Column:
    """Shop, parent place and system joined by a middle dot, without repeats."""
    name = F.coalesce(strip(F.col("name")), F.lit(""))
    shown = F.coalesce(strip(F.col("displayname")), F.lit(""))
    primary = (
        F.when(name == "", shown).when(shown == "", name).when(F.upper(name) == F.upper(shown), shown).otherwise(name)
    )
    place = F.coalesce(*[blank_to_null(F.col(c)) for c in PARENT_FIELDS], F.lit(""))
    cut = F.instr(place, " (")
    parent = F.when(cut > 1, strip(F.substring_index(place, " (", 1))).otherwise(place)
    system = F.coalesce(strip(F.col("star_system_name")), F.lit(""))
    same = lambda a, b: F.upper(a) == F.upper(b)
    return F.concat_ws(
        " · ",
        F.nullif(primary, F.lit("")),
        F.when((parent != "") & ~same(parent, primary), parent),
        F.when((system != "") & ~same(system, parent) & ~same(system, primary), system),
    )


def resolve_scope(requested: Column) -> Column:
    """(scope, id) for a terminal: narrower when the wanted level is not known."""
    planet, orbit = F.col("id_planet") > 0, F.col("id_orbit") > 0
    as_scope = lambda scope, c: F.struct(F.lit(scope).alias("scope"), F.col(c).cast("long").alias("scope_id"))
    return (
        F.when((requested == "PLANET") & planet, as_scope("PLANET", "id_planet"))
        .when(requested.isin("PLANET", "ORBIT") & orbit, as_scope("ORBIT", "id_orbit"))
        .otherwise(as_scope("TERMINAL", "id"))
    )


def name_key() -> Column:
    return F.coalesce(
        F.when(blank_to_null(F.col("displayname")).isNotNull(), F.col("displayname")),
        F.when(blank_to_null(F.col("name")).isNotNull(), F.col("name")),
    )


def ambiguous_names(terminals: DataFrame) -> DataFrame:
    """Names (ignoring case) carried by terminals of two or more systems."""
    keyed = terminals.withColumn("name_key", F.upper(name_key())).filter("name_key is not null")
    return (
        keyed.groupBy("name_key")
        .agg(F.count_distinct(F.upper(F.coalesce("star_system_name", F.lit("")))).alias("n_systems"))
        .filter("n_systems >= 2")
    )


def ambiguous_candidates(terminals: DataFrame) -> DataFrame:
    """Terminals behind each ambiguous name, one row per candidate, ranked by system.

    Rows instead of one array per name, so a very common name needs no huge row.
    """
    keyed = terminals.withColumn("name_key", F.upper(name_key()))
    hits = keyed.join(ambiguous_names(terminals), "name_key")
    return hits.select("name_key", "n_systems", "id", F.coalesce("star_system_name", F.lit("")).alias("star_system"))


def with_container_set(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, csv_ints(F.col(column)))
