"""What ``settle`` leaves on disk."""

from pyspark.sql import functions as F

from tradeq.session import CLEANUP, settle


def test_shuffles_go_with_the_table_written(spark):
    """Blocks of a shuffle are gone when its table is there; the table and its source can be read again."""
    before = spark.conf.get(CLEANUP, None)
    shuffled = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    settled = settle(shuffled, "test")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = manager.getAllFiles().mkString("\n")
    number = spark.sparkContext._jsc.sc().newShuffleId() - 1
    assert f"shuffle_{number}_" not in left
    assert sorted(settled.collect()) == sorted(shuffled.collect())
    assert spark.conf.get(CLEANUP, None) == before
