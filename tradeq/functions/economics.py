"""Price, route and score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
STALE_DAYS = 30
TRAVEL_MM_PER_SECOND = 175.0
TRAVEL_OVERHEAD_SECONDS = 10.0
PROFIT_SATURATION = 5_000_000.0
AGE_SATURATION_DAYS = 180.0
COUNT_SATURATION = 10.0


def epoch_seconds(ts_ntz: Column) -> Column:
    """Unix seconds of a zone-less UTC timestamp, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)


def days_stale(modified: Column, now: Column) -> Column:
    """Whole days since the last update; a true floor, so future dates are negative."""
    return F.floor((now - modified) / F.lit(float(SECONDS_PER_DAY))).cast("int")


def priority(days: Column, stock: Column, status: Column) -> Column:
    boost = F.when(status <= 0, F.lit(0.7)).otherwise(1.0 + status / F.lit(10.0))
    stock_factor = 1.0 + F.log10(1.0 + F.greatest(F.lit(0.0), stock))
    return F.greatest(F.lit(1), days) * stock_factor * boost


def effective_scu(stock: Column, price: Column, budget: Column, vehicle: Column | None = None) -> Column:
    """Units one can really load: stock, then budget cap, then vehicle cap.

    ``least`` skips nulls, so a cap that does not apply is simply null.
    """
    whole = F.floor(stock).cast("long")
    by_budget = F.when((budget > 0) & (price > 0), F.floor(budget / price).cast("long"))
    caps = [whole, by_budget]
    if vehicle is not None:
        caps.append(F.when(vehicle > 0, F.floor(vehicle).cast("long")))
    return F.when(whole <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(*caps)))


def eta_seconds(distance: Column) -> Column:
    return F.when(
        distance > 0, distance * 1000.0 / F.lit(TRAVEL_MM_PER_SECOND) + F.lit(TRAVEL_OVERHEAD_SECONDS)
    ).otherwise(F.lit(0.0))


def profit_per_minute(profit: Column, eta: Column) -> Column:
    return F.when(eta > 0, profit / (eta / 60.0)).otherwise(profit)


def blended_score(profit: Column, max_age: Column, stale_count: Column, slider: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), slider / 100.0))
    by_profit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), profit / F.lit(PROFIT_SATURATION)))
    by_age = F.least(F.lit(1.0), max_age / F.lit(AGE_SATURATION_DAYS))
    by_count = F.least(F.lit(1.0), stale_count / F.lit(COUNT_SATURATION))
    return (1.0 - w) * by_profit + w * (0.7 * by_age + 0.3 * by_count)


def margin_percent(price_from: Column, price_to: Column) -> Column:
    return (price_to - price_from) / price_to * 100.0


def roi_percent(price_from: Column, price_to: Column) -> Column:
    return (price_to - price_from) / price_from * 100.0
