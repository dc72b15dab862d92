"""Documented example values."""

import pytest
from pyspark.sql import functions as F

from tradeq.functions import economics as E
from tradeq.functions import text as T
from tradeq.operators import extract as X
from tradeq.operators import similarity as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "digits, sizes",
    [("124816", [1, 2, 4, 8, 16]), ("1248162432", [1, 2, 4, 8, 16, 24, 32]), ("48162432", [4, 8, 16, 24, 32]), ("1", None), ("77", None)],
)
def test_sizes(spark, digits, sizes):
    assert one(spark, X.digit_sizes(F.lit(digits))) == sizes


@pytest.mark.parametrize(
    "token, fixed",
    [("B0OO", "8000"), ("30OO", "3000"), ("lI20", "1120"), ("5S00", "5500"), ("120/SCU", "120/SCU"), ("BORON", "BORON"), ("a 1O b", "a 10 b")],
)
def test_repair(spark, token, fixed):
    assert one(spark, X.repair_numeric(F.lit(token))) == fixed


@pytest.mark.parametrize("line, price", [("1.42599999M/SCU", 1425999.99), ("323/SCU", 323.0), ("3.5/SCU", 35.0), ("1,5K/SCU", 1500.0), ("1.2.3K/SCU", 1230.0)])
def test_price(spark, line, price):
    assert one(spark, X.parse_price(F.lit(line))) == pytest.approx(price)


def test_scu(spark):
    assert one(spark, X.parse_scu(F.lit("21,600 SCU"))) == 21600


@pytest.mark.parametrize(
    "line, status",
    [("Medsum Inventory", 4), ("MAX. INVENTORY", 7), ("VERY HIGH INVENTORY", 6), ("QUT DE STOCK", 1), ("IN STOCK", None), ("LARANITE", None), ("FULL", 7)],
)
def test_status(spark, line, status):
    assert one(spark, X.label_status(F.lit(line))) == status


def test_economics(spark):
    assert one(spark, F.round(E.margin_percent(F.lit(229.0), F.lit(450.0)), 2)) == 49.11
    assert one(spark, F.round(E.roi_percent(F.lit(229.0), F.lit(450.0)), 2)) == 96.51
    assert one(spark, E.effective_scu(F.lit(2100.0), F.lit(2990.0), F.lit(300000))) == 100


@pytest.mark.parametrize(
    "a, b, ratio, penalised, partial",
    [("STINS", "STIMS", 80, 80, 80), ("STINS", "TIN", 60, 36, 100), ("BIOPLASTIC", "BIO", 30, 9, 100), ("MEDSUM", "MEDIUM", 83, 83, 83)],
)
def test_scores(spark, a, b, ratio, penalised, partial):
    assert one(spark, T.ratio(F.lit(a), F.lit(b))) == ratio
    assert one(spark, S.penalised(T.ratio(F.lit(a), F.lit(b)), F.lit(len(a)), F.lit(len(b)))) == penalised
    assert one(spark, T.partial(F.lit(a), F.lit(b))) == partial


@pytest.mark.parametrize("name", ["ScreenShot-2026-05-02_22-58-28-DB6.jpg", "d/ScreenShot-2026-05-02_22-58-28.jpg"])
def test_capture_time(spark, name):
    assert one(spark, X.capture_time(F.lit(name))) == "2026-05-02 22:58:28"


GOLDEN_TEXT = """COMMODITIES
CURRENT BALANCE
YOUR INVENTORIES
EVERUS HARBOR
IN DEMAND
NO DEMAND
CANNOT SELL
SHOP INVENTORY
BUY
LOCAL MARKET VALUE
IN STOCK
SCRAP
MAX INVENTORY
SHOP QUANTITY
3,000 SCU
1.42599999M/SCU
AVAILABLE CARGO SIZE (SCU)
1 2 4 8 16 24 32
IRON
MAX INVENTORY
SHOP QUANTITY
21,600 SCU
323/SCU
TUNGSTEN
MAX INVENTORY
SHOP QUANTITY
10,800 SCU
525/SCU"""


def test_screen_to_rows(rows):
    lines = rows("capture_id long, line_no long, text string", *[(1, i, t) for i, t in enumerate(GOLDEN_TEXT.split("\n"))])
    goods = rows(
        "id long, name string, code string",
        (1, "Scrap", "SCRA"), (2, "Iron", "IRON"), (3, "Tungsten", "TUNG"), (4, "Stims", "STIM"), (5, "Tin", "TIN"),
    )
    got = X.extract_rows(lines, goods).orderBy("row_index").collect()
    assert [(r.id_commodity, r.scu, round(r.price, 2), r.status) for r in got] == [
        (1, 3000, 1425999.99, 7), (2, 21600, 323.0, 7), (3, 10800, 525.0, 7),
    ]
    assert X.container_union(X.extract_sizes(lines), lines).first()["container_sizes"] == "1,2,4,8,16,24,32"


def test_length_penalty_decides(rows):
    goods = rows("id long, name string, code string", (1, "Tin", "TIN"), (2, "Stims", "STIM"), (3, "Bio", "BIO"), (4, "Bioplastic", "BIOP"))
    got = {r.token: r.matched_id for r in S.resolve_commodities(rows("token string", ("STINS",), ("BIOPLASTIC",), ("XY",)), goods).collect()}
    assert got == {"STINS": 2, "BIOPLASTIC": 4}
