"""Streaming forms: new captures, duplicate guard, quota, latest prices, overlay refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradeq.schemas import BINARY_FILE
from tradeq.session import shared_dir
from tradeq.sources.files import IMAGE_PATTERN

DUPLICATE_SECONDS = 300
QUOTA, QUOTA_SECONDS = 1000, 1800


def stream_captures(spark: SparkSession, folders: dict[str, str], accepted: DataFrame) -> DataFrame:
    """New image files of several tagged folders, minus accepted names.

    Writers must move finished files in; contents are not read.
    """
    tagged = None
    for branch, folder in folders.items():
        found = (
            spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)
            .select(
                F.lit(branch).alias("branch"),
                "path",
                F.element_at(F.split("path", "/"), -1).alias("name"),
                F.col("modificationTime").alias("modified"),
            )
        )
        tagged = found if tagged is None else tagged.unionByName(found)
    images = tagged.filter(F.lower("name").rlike(IMAGE_PATTERN)).withColumn("source_key", F.upper("name"))
    return images.join(accepted.select("source_key"), "source_key", "left_anti").drop("source_key")


def stream_dedup(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Approximate guard: one event per key within the watermark; may block too much."""
    return events.withWatermark(ts, f"{DUPLICATE_SECONDS} seconds").dropDuplicatesWithinWatermark(keys)


def _spaced(times, last: float | None):
    """Flags of the times (ascending) that are accepted, and the last accepted time.

    Jumps from one accepted time to the next; what lies between is not visited.
    """
    times = np.asarray(times)
    flags = np.zeros(len(times), bool)
    at = 0 if last is None else int(np.searchsorted(times, last + DUPLICATE_SECONDS, "right"))
    while at < len(times):
        flags[at] = True
        last = times[at]
        at = int(np.searchsorted(times, last + DUPLICATE_SECONDS, "right"))
    return flags, last


def accept_spaced(events: DataFrame, keys: list[str]) -> DataFrame:
    """Exact batch guard: an event is accepted unless one was accepted in the 5 minutes before.

    Only accepted events block, so each decision needs the one before it. Rows
    are shuffled by key and sorted; each task walks its rows in Arrow batches and
    carries one time per key, so no key is ever held in memory as a whole.
    ``sent_at`` is in seconds; ``id`` breaks ties.
    """
    schema = events.schema.simpleString()[len("struct<"):-1]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            flags = np.zeros(len(pdf), bool)
            numbers = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(pdf)]
            times = pdf["sent_at"].to_numpy()
            for a, b in zip(starts, starts[1:]):
                own = tuple(None if pd.isna(x) else x for x in pdf[keys].iloc[a])
                flags[a:b], last = _spaced(times[a:b], last if own == key else None)
                key = own
            yield pdf[flags]

    ordered = events.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "sent_at", "id")
    return ordered.mapInPandas(walk, _ddl(schema))


def _ddl(simple: str) -> str:
    return f"struct<{simple}>"


def stream_accept(events: DataFrame, keys: list[str]) -> DataFrame:
    """Exact guard on a stream: state is the last accepted time per key.

    A key is forgotten once the watermark has passed its window.
    """
    fields = [events.schema[k].simpleString().replace(":", " ") for k in keys]
    out = ", ".join([*fields, "id bigint", "sent_at bigint"])

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # only the first event of a second can be accepted, so one row a second is held
        first: dict[int, tuple] = {}
        for batch in batches:
            heads = batch.sort_values(["sent_at", "id"]).drop_duplicates("sent_at")
            for row in heads[[*keys, "id", "sent_at"]].itertuples(index=False, name=None):
                if row[-1] not in first or row[-2] < first[row[-1]][-2]:
                    first[row[-1]] = row
        rows = pd.DataFrame([first[t] for t in sorted(first)], columns=[*keys, "id", "sent_at"])
        last = state.get[0] if state.exists else None
        flags, last = _spaced(rows["sent_at"], last)
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int(last) + DUPLICATE_SECONDS + 1, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield rows.loc[flags, [*keys, "id", "sent_at"]]

    return (
        events.withWatermark("ts", f"{DUPLICATE_SECONDS} seconds")
        .groupBy(*keys)
        .applyInPandasWithState(decide, out, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def stream_quota(events: DataFrame, user: str, limit: int = QUOTA, window: int = QUOTA_SECONDS, late: int = QUOTA_SECONDS) -> DataFrame:
    """Reports of a user in the ``window`` seconds up to and including each second with a report. Use update mode.

    A true sliding count: no burst hides at the edge of a window. ``sent_at`` is in seconds,
    ``ts`` the same as timestamp. State is one count per second with a report, as far back
    as an event may still look, so its size is bounded by time however many reports a user
    sends. A report that comes up to ``late`` seconds late corrects the seconds after it,
    which are told again; later ones are dropped by the watermark.
    """
    kind = events.schema[user].dataType.simpleString()

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get)) if state.exists else {}
        fresh: set[int] = set()
        for batch in batches:
            for second, n in zip(*np.unique(batch["sent_at"].to_numpy(), return_counts=True)):
                held[int(second)] = held.get(int(second), 0) + int(n)
                fresh.add(int(second))
        seconds = np.array(sorted(held), np.int64)
        counts = np.array([held[x] for x in seconds.tolist()], np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        n = total[1:] - total[np.searchsorted(seconds, seconds - window, "right")]
        new = np.array(sorted(fresh), np.int64)
        # a second changes if a fresh one lies in its window
        changed = np.searchsorted(new, seconds, "right") > np.searchsorted(new, seconds - window, "right")
        yield pd.DataFrame({user: key[0], "sent_at": seconds[changed], "n_reports": n[changed], "over_limit": n[changed] > limit})
        mark = state.getCurrentWatermarkMs() // 1000
        keep = seconds > mark - window
        state.update((seconds[keep].tolist(), counts[keep].tolist()))
        state.setTimeoutTimestamp((max(int(seconds[-1]) + window, mark) + 1) * 1000)

    return (
        events.withWatermark("ts", f"{late} seconds")
        .groupBy(user)
        .applyInPandasWithState(
            count, f"{user} {kind}, sent_at bigint, n_reports bigint, over_limit boolean",
            "seconds array<bigint>, counts array<bigint>", "update", GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_latest(observations: DataFrame) -> DataFrame:
    """Newest price per key; an older late row can never win. Use update mode."""
    return observations.groupBy("id_terminal", "id_commodity", "side").agg(
        F.max(F.struct("ts", "price", "stock", "status")).alias("n")
    ).select("id_terminal", "id_commodity", "side", "n.*")


def run_updates(
    stream: DataFrame,
    keys: list[str],
    purpose: str,
    batch: Callable[[DataFrame], DataFrame] | None = None,
    target: str | None = None,
    trigger: dict | None = None,
) -> DataFrame:
    """Run a stream in update mode into a table and return the last update per key.

    ``target`` is the caller's folder for updates and checkpoint: a later run with the same
    folder goes on where the last one stopped. Without it the job has a folder of its own.
    ``trigger`` is what ``DataStreamWriter.trigger`` takes; the default drains what is there.
    """
    spark = stream.sparkSession
    target = target or shared_dir(spark, purpose)

    def write(df: DataFrame, batch_id: int) -> None:
        out = batch(df) if batch else df
        # a repeated batch overwrites itself
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/updates/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint")
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    updates = spark.read.parquet(f"{target}/updates").drop("batch")
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("u")).select(*keys, "u.*")


def run_appends(stream: DataFrame, purpose: str, target: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Run a stream in append mode into Parquet files and read them; ``target`` and ``trigger`` as in ``run_updates``."""
    spark = stream.sparkSession
    target = target or shared_dir(spark, purpose)
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{target}/checkpoint")
    writer.trigger(**(trigger or {"availableNow": True})).start(f"{target}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def stream_overlay(
    observations: DataFrame,
    overlay_of: Callable[[DataFrame], DataFrame],
    purpose: str = "overlay",
    target: str | None = None,
    trigger: dict | None = None,
) -> DataFrame:
    """Refresh the terminal overlay as prices arrive, for the touched terminals only.

    Each micro-batch is appended to the price log; the overlay is worked out again
    from the log cut down (semi join) to terminals of the batch. ``overlay_of``
    maps observations to one row per ``id_terminal``.
    """
    spark = observations.sparkSession
    target = target or shared_dir(spark, purpose)
    log, schema = f"{target}/log", observations.schema

    def refresh(df: DataFrame, batch_id: int) -> None:
        # one folder per batch: a repeated batch overwrites itself
        df.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        seen = spark.read.schema(schema).parquet(f"{log}/batch=*")
        touched = spark.read.schema(schema).parquet(f"{log}/batch={batch_id}").select("id_terminal").distinct()
        fresh = overlay_of(seen.join(touched, "id_terminal", "left_semi"))
        fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/overlay/batch={batch_id}")

    writer = observations.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{target}/checkpoint")
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    updates = spark.read.parquet(f"{target}/overlay").drop("batch")
    newest = W.partitionBy("id_terminal").orderBy(F.col("batch_id").desc())
    return updates.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn", "batch_id")
