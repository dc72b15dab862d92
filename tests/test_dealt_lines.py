"""Lines of captures are dealt by their number, and by nothing else that many of them share."""

import re

import pytest
from pyspark.sql import functions as F

from tradeq.operators import extract as X
from tradeq.operators import ordered
from tradeq.session import settle

SCREEN = ["LOCAL MARKET VALUE", "RAW IRON", "SHOP QUANTITY", "12 SCU", "3.5K/SCU", "AVAILABLE CARGO SIZE (SCU)", "1 2 4 8 16", None]


def lines_of(rows):
    cells = [(c, i * 3, "BUY" if c % 2 and i == 0 else t) for c in range(40) for i, t in enumerate(SCREEN)]
    return settle(rows("capture_id long, line_no long, text string", *cells), "lines")


def parts(df, capsys):
    capsys.readouterr()
    df.explain()
    return re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)


@pytest.mark.parametrize("per_task", [10, 1_000_000])
def test_the_number_of_lines_tells_the_number_of_tasks(spark, rows, monkeypatch, capsys, per_task):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", per_task)
    goods = rows("id long, name string, code string", (7, "Raw Iron", "RAI"))
    lines = lines_of(rows)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = lambda n: ("capture_id", str(max(least, -(-n // per_task))))
    tabs, sizes, classes = X.detect_tab(lines), X.extract_sizes(lines), X.classify_lines(lines, goods)
    for df in (tabs, sizes, classes):
        assert parts(df, capsys)[-1] in (want(320), want(280))
    assert {(r.capture_id, r.tab) for r in tabs.collect()} == {(c, "BUY" if c % 2 else "SELL") for c in range(40)}
    assert {(r.capture_id, r.line_no, tuple(r.sizes)) for r in sizes.collect()} == {(c, 18, (1, 2, 4, 8, 16)) for c in range(40)}
    kinds = classes.filter("kind in ('COMMODITY', 'SCU', 'PRICE')").select("capture_id", "line_no", "kind", "id_commodity", "scu", "price")
    assert {tuple(r) for r in kinds.collect()} == {
        x for c in range(40) for x in [(c, 3, "COMMODITY", 7, None, None), (c, 9, "SCU", None, 12, None), (c, 12, "PRICE", None, None, 3500.0)]
    }


def test_only_telling_texts_are_looked_up(rows, monkeypatch):
    written = {}
    monkeypatch.setattr(X, "settle", lambda df, purpose: written.setdefault(purpose, settle(df, purpose)))
    lines = lines_of(rows)
    X.detect_tab(lines).collect()
    assert {r.told for r in written["told-texts"].select(F.col("text").alias("told")).collect()} == {"BUY", "LOCAL MARKET VALUE"}


def test_costly_rows_are_dealt_by_their_number(spark):
    table = settle(spark.range(0, 5000, 1, 1), "turns")
    cores = spark.sparkContext.defaultParallelism
    assert ordered.widen(table).rdd.getNumPartitions() == cores
    dealt = ordered.widen(table, 100)
    assert dealt.rdd.getNumPartitions() == 50 and ordered.widen(table, 10_000).rdd.getNumPartitions() == cores
    assert dealt.agg(F.sum("id")).first()[0] == sum(range(5000))
