"""Quality of extraction: error rates, completeness, engine report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeq.functions.text import strip

def plain_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\r\n?", "\n"))


def _rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def char_error(reference: Column, hypothesis: Column) -> Column:
    """Character edits per reference character; can exceed 1."""
    r, h = plain_text(reference), plain_text(hypothesis)
    return _rate(F.levenshtein(r, h), F.char_length(r), F.char_length(h))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.upper(plain_text(c)), r"[ \t\n]+"), lambda w: w != "")


def edit_distance(a: list, b: list) -> int:
    """Edits between two sequences of any length, by bit vectors.

    Bit i of the vectors tells whether the distance grows or shrinks from place i of ``a`` to
    the next; one item of ``b`` moves all places at once, so the work is len(b) operations on
    numbers of len(a) bits, and the memory is a few such numbers.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a) or not len(b):
        return len(a) + len(b)
    at: dict = {}
    for i, item in enumerate(a):
        at[item] = at.get(item, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = whole, 0, len(a)
    for item in b:
        same = at.get(item, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & whole
        grows = down | (whole & ~(diagonal | up))
        shrinks = up & diagonal
        if grows & last:
            distance += 1
        elif shrinks & last:
            distance -= 1
        grows = (grows << 1 | 1) & whole
        up = (shrinks << 1 & whole) | (whole & ~(diagonal | grows))
        down = grows & diagonal
    return distance


def word_error(df: DataFrame, reference: str, hypothesis: str, out: str) -> DataFrame:
    """Word edits per reference word, ignoring case; a text may have any number of words."""
    worded = df.withColumns({"_r": _words(F.col(reference)), "_h": _words(F.col(hypothesis))})
    distance = F.pandas_udf(_distances, T.LongType())("_r", "_h")
    return worded.withColumn(out, _rate(distance, F.size("_r"), F.size("_h"))).drop("_r", "_h")


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    known = [None if x is None or y is None else edit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    return pd.Series(known, dtype="Int64")


def error_rates(pairs: DataFrame) -> DataFrame:
    """``cer`` and ``wer`` of (reference, hypothesis); NaN where there is no reference."""
    nan = F.lit(float("nan"))
    known = F.col("reference").isNotNull()
    rated = word_error(pairs, "reference", "hypothesis", "wer").withColumn(
        "cer", char_error(F.col("reference"), F.col("hypothesis"))
    )
    return rated.withColumns({c: F.when(known, F.col(c)).otherwise(nan) for c in ("cer", "wer")})


def engine_report(runs: DataFrame) -> DataFrame:
    """Means per engine; a NaN rate makes the engine's mean NaN."""
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return runs.groupBy("engine").agg(mean("cer"), mean("wer"), mean("confidence"), mean("elapsed_ms"))


def completeness(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows parsed, rows with all of id, quantity and price, and mean match score per capture."""
    whole = F.col("id_commodity").isNotNull() & F.col("scu").isNotNull() & F.col("price").isNotNull()
    per = rows.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count_if(whole).alias("rows_complete"),
        F.avg("match_score").alias("mean_score"),
    )
    return captures.select("capture_id").join(per, "capture_id", "left").fillna(
        0, subset=["rows_parsed", "rows_complete", "mean_score"]
    )


def mean_confidence(captures: DataFrame, regions: DataFrame) -> DataFrame:
    per = regions.groupBy("capture_id").agg(F.avg("confidence").alias("mean_confidence"))
    return captures.select("capture_id").join(per, "capture_id", "left").fillna(0.0, subset=["mean_confidence"])
