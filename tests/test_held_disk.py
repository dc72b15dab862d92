"""What a query still shuffles when its result is read: steps before were written, and their shuffles dropped."""

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_gated_batch_reads_no_table_while_its_result_is_made(spark):
    plan = plan_of(queries()["gated_batch"](spark, FOLDER))
    assert f"{FOLDER}/" not in plan


def test_scoped_routes_reads_no_table_while_its_result_is_made(spark):
    plan = plan_of(queries()["scoped_routes"](spark, FOLDER))
    assert f"{FOLDER}/" not in plan
