"""First-per-key and running counts that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_winner(df: DataFrame, keys: list[str], order: dict[str, Column]) -> DataFrame:
    """Add ``winner``: the struct ``order`` of the row that sorts first in its key.

    The minimum is combined on the map side, and the join back is an equi-join
    that adaptive execution can split, so a key holding a third of all rows is
    spread over tasks. A ranking window would sort that key in one task.
    """
    mine = F.struct(*[c.alias(name) for name, c in order.items()])
    winners = df.groupBy(*keys).agg(F.min(mine).alias("winner"))
    return df.join(winners, keys)


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, out: str, width: int = 100_000) -> DataFrame:
    """Inclusive count of ``flag`` in ``order`` (a whole number, unique per key).

    Two levels: a window inside each stretch of ``width`` order values, plus the
    totals of the earlier stretches, which is a small table.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width))
    one = F.when(flag, 1).otherwise(0)
    totals = cut.groupBy(*keys, "_stretch").agg(F.sum(one).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.sum(one).over(inside))
        .join(offsets, [*keys, "_stretch"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_stretch", "_inside", "_before")
    )


def spread_distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of ``column`` over the session's shuffle partition count.

    Made for small tables with costly work per row: adaptive execution would
    merge their few bytes into one task, but keeps an explicit partition count.
    The second grouping needs no shuffle; its count ``n`` (always 1) is used by
    ``costly_filter``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return distinct.repartition(parts, column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def costly_filter(df: DataFrame, condition: Column) -> DataFrame:
    """Filter rows of ``spread_distinct``, evaluated there.

    As the condition reads ``n``, the optimizer cannot push it below the
    de-duplication, where it would run once per input row.
    """
    return df.filter(F.when(F.col("n") > 0, condition)).drop("n")


#: Rows that one task sorts at most, on average; a row with its text takes some 300 bytes there.
ROWS_PER_TASK = 1_000_000


def dealt(df: DataFrame, column: str, n_rows: int | None = None) -> DataFrame:
    """Rows of a written table (or ``n_rows`` rows) dealt by ``column`` over as many tasks as their number asks for.

    Adaptive execution measures partitions as they are packed for the shuffle; repeated texts
    pack to a tenth, so the few tasks it leaves would sort more than they can hold. An explicit
    count is kept. Counting reads the footers of the files only.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = df.count() if n_rows is None else n_rows
    return df.repartition(max(parts, -(-n_rows // ROWS_PER_TASK)), column)


def widen(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Deal rows of a narrow scan over all cores before costly work per row.

    A table in many files or row groups already has enough tasks and is returned
    as it is, so on a cluster this adds no shuffle. Where a row takes milliseconds,
    ``rows_per_task`` bounds a task also on a table of many rows.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        parts = max(parts, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)
