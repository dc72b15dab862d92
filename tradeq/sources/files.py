"""Listings of capture files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_PATTERN = r"\.(png|jpg|jpeg|bmp)$"


def write_files(files: DataFrame, folder: str) -> int:
    """Write every (name, content) as a file of its own below a folder all executors reach; returns how many.

    A file is moved in whole, so readers and streams never see half of it, and a repeated
    task replaces it with the same bytes. ``name`` may hold sub-folders.
    """
    def place(path: str):
        if path.startswith("file:"):
            path = re.sub("^file:/+", "/", path)
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                target = f"{root}/{name}"
                head, _, last = target.rpartition("/")
                system.create_dir(head, recursive=True)
                beside = f"{head}/_{last}.{uuid.uuid4().hex}"  # names with an underscore are hidden from readers
                with system.open_output_stream(beside) as out:
                    out.write(bytes(content))
                system.move(beside, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, modified) of a folder; file contents are never read."""
    found = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.unix_timestamp("modificationTime").alias("modified"),
    )


def pending_files(files: DataFrame, accepted: DataFrame, since: int | None = None) -> DataFrame:
    """Image files not accepted before, oldest first. ``accepted`` holds upper-cased names."""
    images = files.filter(F.lower("name").rlike(IMAGE_PATTERN))
    if since is not None:
        images = images.filter(F.col("modified") >= since)
    sent = accepted.select("source_key")
    return images.join(sent, F.upper(images["name"]) == sent["source_key"], "left_anti").orderBy("modified", "name")
