"""The submission log: append, look-ups, retries, sources and funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.functions.text import blank_to_null
from tradeq.functions.values import json_strings

MAX_RETRIES = 3


def log_rows(df: DataFrame) -> DataFrame:
    """List columns as JSON text; an empty image list is stored as null."""
    return df.withColumns(
        {
            "source_images": F.when(F.size("source_images") > 0, F.to_json("source_images")),
            "submitted_commodity_ids": F.to_json("submitted_commodity_ids"),
            "dt": F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("sent_at") / 86400).cast("int")),
        }
    )


def append_submissions(df: DataFrame, path: str) -> None:
    """Append to the log, one folder per day; rows of a day are gathered before the write.

    Adaptive execution splits a day by its size in bytes.
    """
    log_rows(df).hint("rebalance", "dt").sortWithinPartitions(
        "dt", "id_terminal", F.col("sent_at").desc()
    ).write.mode("append").partitionBy("dt").parquet(path)


def recent_submissions(log: DataFrame, now: int, window: int) -> DataFrame:
    """Rows at or after floor(now - window). The day filter prunes folders."""
    since = now - window
    first_day = F.date_add(F.lit("1970-01-01").cast("date"), since // 86400)
    return log.filter((F.col("dt") >= first_day) & (F.col("sent_at") >= since))


def latest_submissions(log: DataFrame, n: int = 200) -> DataFrame:
    return log.orderBy(F.col("sent_at").desc(), F.col("id").desc()).limit(n)


def is_retryable() -> Column:
    """Worth another try: rate limited or server failure, and attempts left."""
    code = F.col("http_status")
    transient = (
        (F.lower(F.trim(F.coalesce("api_status", F.lit("")))) == "too_many_reports")
        | (code == 429)
        | ((code >= 500) & (code < 600))
    )
    return (F.col("attempt") < MAX_RETRIES) & transient


def submitted_sources(log: DataFrame, production_only: bool = True) -> DataFrame:
    """Distinct accepted source names ignoring case, from both name columns."""
    accepted = log.filter("ok")
    if production_only:
        accepted = accepted.filter("is_production")
    names = F.concat(
        F.array("source_image"), F.coalesce(json_strings(F.col("source_images")), F.array().cast("array<string>"))
    )
    return (
        accepted.select(F.explode(names).alias("source"))
        .filter(blank_to_null(F.col("source")).isNotNull())
        .groupBy(F.upper("source").alias("source_key"))
        .agg(F.min("source").alias("source"))
    )


def funnel(items: DataFrame, keys: list[str]) -> DataFrame:
    """Inbox counts per key; ready to send when something is validated and nothing pending."""
    status = F.col("inbox_status")
    return (
        items.groupBy(*keys)
        .agg(
            F.count_if(status == "VALIDATED").alias("validated"),
            F.count_if(status == "FAILED").alias("failed"),
            F.count_if(~status.isin("VALIDATED", "FAILED", "SENT")).alias("pending"),
        )
        .withColumn("ready_to_send", (F.col("validated") > 0) & (F.col("pending") == 0))
    )
