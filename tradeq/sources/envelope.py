"""API answers kept as JSON files: an envelope around a list or one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeq.schemas import ENVELOPE, GROUND_TRUTH


def read_envelope(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the envelopes under ``path``.

    ``whole_file`` takes each file as one envelope, else each line is one, which
    lets Spark split large files. An envelope counts only if its status is "ok"
    in any case; ``data`` may be an array or a single object.
    """
    texts = spark.read.text(path, wholetext=whole_file).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", ENVELOPE).alias("e")
    )
    accepted = F.coalesce(F.lower("e.status") == "ok", F.lit(False))
    rows = texts.filter(accepted).select(F.inline(F.from_json("e.data", f"array<struct<{_fields(schema)}>>")))
    rejects = texts.filter(~accepted).select("file", "e.status", "e.message", "e.http_code")
    return rows, rejects


def _fields(schema: str) -> str:
    """Column list "a int, b string" in the form used inside struct<>."""
    return ",".join(":".join(part.strip().split(" ", 1)) for part in schema.split(","))


def load_ground_truth(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Expected content per image, nested rows included."""
    return spark.read.schema(GROUND_TRUTH).json(path, multiLine=multi_line)
