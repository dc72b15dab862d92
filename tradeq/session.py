"""Session helpers shared by the bench, the tests and the streaming jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files go as soon as the query that wrote them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written by ``settle`` inside the innermost ``settle_alone``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def local_session(cpus: int = 8, name: str = "tradeq") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no call-site capture per expression: large expressions build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job under the shared folder of the cluster.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset (one
    machine, as in tests) a temporary folder is made, recorded, and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tradeq-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)  # made here, so removed here
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tradeq/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    For results read several times: the work before is not repeated, and a lost
    executor only costs the tasks after this point. What was shuffled for ``df`` is
    dropped when the files are there, as nothing reads it again. The folder belongs
    to the job; whoever set ``spark.checkpoint.dir`` also expires it.
    """
    path = shared_dir(df.sparkSession, purpose)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    if (written := _written.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """``settle`` what ``make`` returns, then drop the tables that were settled on the way to it.

    For a small result of many large steps. Nothing else that ``make`` built may be read later.
    """
    token = _written.set([])
    try:
        kept = settle(make(), purpose)
        *steps, own = _written.get()
    finally:
        _written.reset(token)
    for step in steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(step)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if (outer := _written.get()) is not None:
        outer.append(own)
    return kept
