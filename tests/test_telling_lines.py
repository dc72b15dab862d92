"""Lines of captures that are written between reading and assembling."""

from pyspark.sql import functions as F

from tradeq.operators import extract as X


def test_lines_that_tell_nothing_change_no_row(spark):
    kinds = ["capture_id long", "line_no long", "kind string", "line string", "id_commodity long", "match_score double", "scu int", "price double", "status int"]
    rows = [
        (1, 0, "OTHER", "--- ROW 1", None, None, None, None, None), (1, 1, "OTHER", "MAX INVENTORY", None, None, None, None, 7),
        (1, 2, "COMMODITY", "--- ROW OF TIN", 5, 90.0, None, None, None), (1, 3, "OTHER", "noise", None, None, None, None, None),
        (1, 4, "SCU", "5 SCU", None, None, 5, None, None), (1, 5, "SKIP", "", None, None, None, None, None),
        (1, 6, "PRICE", "7/SCU", None, None, None, 7.0, 3), (1, 7, "COMMODITY", "LEAD", 6, 95.0, None, None, None),
        (2, 0, "OTHER", "noise", None, None, None, None, None), (3, 0, "COMMODITY", "TIN", 5, 80.0, None, None, None),
    ]
    lines = spark.createDataFrame(rows, ", ".join(kinds))
    told = X.telling_lines(lines)
    assert told.count() == 7
    bag = lambda df: sorted(map(str, df.collect()))
    for step in (X.assemble_rows, X.commodity_status):
        assert bag(step(told)) == bag(step(lines))
    assert told.agg(F.max(F.length("line"))).first()[0] == len(X.BAND_MARKER)
