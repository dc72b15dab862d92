"""Which prices are old, how urgent they are, and what was just submitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.functions.economics import STALE_DAYS, days_stale, priority

RECENT_SECONDS = 6 * 3600


def stale_targets(prices: DataFrame, now: int) -> DataFrame:
    """One row per priced side of each (terminal, commodity), with age and priority."""
    side = lambda name, price, stock, status: F.struct(
        F.lit(name).alias("side"),
        F.col(price).alias("last_price"),
        F.col(stock).alias("stock"),
        F.col(status).alias("status"),
    )
    sides = F.array(
        side("BUY", "price_buy", "scu_buy", "status_buy"),
        side("SELL", "price_sell", "scu_sell_stock", "status_sell"),
    )
    return (
        prices.filter("date_modified > 0")
        .select("id_terminal", "id_commodity", "date_modified", F.inline(sides))
        .filter("last_price > 0")
        .withColumn("days_stale", days_stale(F.col("date_modified"), F.lit(now)))
        .withColumn("priority", priority(F.col("days_stale"), F.col("stock"), F.col("status")))
    )


def enrich_targets(targets: DataFrame, terminals: DataFrame) -> DataFrame:
    """Add system, name and reachability; with an empty catalog all stay reachable."""
    flags = terminals.agg((F.count(F.lit(1)) > 0).alias("has_catalog"))
    known = terminals.select(
        F.col("id").alias("id_terminal"),
        F.col("name").alias("terminal_name"),
        F.col("star_system_name").alias("star_system"),
        (F.col("is_available_live") != 0).alias("live"),
    )
    joined = targets.join(known, "id_terminal", "left")
    # the one-row flag is a scalar subquery, not a join
    has_catalog = flags.scalar()
    return joined.withColumn("is_reachable", F.coalesce("live", ~has_catalog)).drop("live")


def filter_targets(
    targets: DataFrame,
    text: str | None = None,
    over30: bool = False,
    buy: bool = True,
    sell: bool = True,
    unreachable: bool = False,
) -> DataFrame:
    """The list filter: reachability, age, sides and a free-text needle."""
    keep: list[Column] = []
    if not unreachable:
        keep.append(F.col("is_reachable"))
    if over30:
        keep.append(F.col("days_stale") >= STALE_DAYS)
    if not buy:
        keep.append(F.col("side") != "BUY")
    if not sell:
        keep.append(F.col("side") != "SELL")
    needle = (text or "").strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("terminal_name", "commodity_name", "star_system"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        keep.append(hit)
    for condition in keep:
        targets = targets.filter(condition)
    return targets


def recent_pairs(submissions: DataFrame, now: int, window: int = RECENT_SECONDS) -> DataFrame:
    """Distinct (terminal, commodity) submitted OK within the window before ``now``."""
    return (
        submissions.filter(F.col("ok") & (F.col("sent_at") >= now - window))
        .select("id_terminal", F.explode(F.from_json("submitted_commodity_ids", "array<bigint>")).alias("id_commodity"))
        .distinct()
    )


def exclude_recent(targets: DataFrame, recent: DataFrame) -> DataFrame:
    return targets.join(recent, ["id_terminal", "id_commodity"], "left_anti")


def mark_recent(targets: DataFrame, recent: DataFrame) -> DataFrame:
    flagged = recent.withColumn("is_recent", F.lit(True))
    return targets.join(flagged, ["id_terminal", "id_commodity"], "left").withColumn(
        "is_recent", F.coalesce("is_recent", F.lit(False))
    )


def staleness_by_terminal(flagged: DataFrame) -> DataFrame:
    """Per terminal over reachable targets marked ``is_recent``: oldest age, 30-day count, excluded count."""
    old = F.col("days_stale") >= STALE_DAYS
    usable = ~F.col("is_recent")
    return (
        flagged.groupBy("id_terminal")
        .agg(
            F.coalesce(F.max(F.when(usable, F.col("days_stale"))), F.lit(0)).alias("max_days"),
            F.count_if(old & usable).alias("stale_count"),
            F.count_if(old).alias("raw_count"),
        )
        .withColumn("excluded_count", F.col("raw_count") - F.col("stale_count"))
    )


def terminal_staleness(targets: DataFrame, recent: DataFrame) -> DataFrame:
    """``staleness_by_terminal`` of targets and what was submitted lately."""
    return staleness_by_terminal(mark_recent(targets.filter("is_reachable"), recent))


def rank_targets(targets: DataFrame) -> DataFrame:
    return targets.orderBy(F.col("priority").desc(), "id_terminal", "id_commodity", "side")
