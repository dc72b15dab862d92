"""Whole files in the shared folder, opened by tasks.

Spark's own readers and writers are used wherever rows are enough. Two operators need
more: a file format of their own, and single blocks of a Parquet file. The folder is
the one named by ``spark.checkpoint.dir``, which all executors reach.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI (``file:``, ``hdfs://``, ``s3://`` ...) or a local path."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> str:
    system, plain = place(path)
    system.create_dir(plain, recursive=True)
    return path


def write_whole(path: str, data: bytes) -> None:
    """A file appears whole or not at all; a repeated attempt of a task replaces it with the same bytes."""
    system, plain = place(path)
    beside = f"{plain}.{uuid.uuid4().hex}.unfinished"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, plain)


def files(path: str, ending: str) -> list[str]:
    """Plain paths of the files of a folder, in order of their names."""
    system, plain = place(path)
    found = system.get_file_info(fs.FileSelector(plain))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(ending))
