"""Domain tables derived from the given TPC-H style Parquet tables.

``Market(spark, folder)`` reads lazily; each method returns a DataFrame that
Catalyst prunes down to the columns a query really uses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.functions.economics import epoch_seconds
from tradeq.operators.ordered import widen

NOW = 1007164800  # 2001-12-01T00:00:00Z, the evaluation time of the price queries
LOG_NOW = 1706572800  # 2024-01-30T00:00:00Z, the evaluation time of the log queries

ROW_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def title_words(c: Column) -> Column:
    """Two-word name in title case."""
    return F.initcap(c)


def unit_price() -> Column:
    """Price of one unit in whole cents."""
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100


@dataclass(frozen=True)
class Market:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- prices -----------------------------------------------------------

    def observations(self) -> DataFrame:
        """One price report per lineitem."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_suppkey").alias("id_terminal"),
            F.col("l_partkey").alias("id_commodity"),
            F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
            unit_price().alias("price"),
            F.col("l_quantity").alias("stock"),
            F.col("l_linenumber").alias("status"),
            epoch_seconds(F.col("l_shipdate")).alias("ts"),
        )

    def prices_all(self) -> DataFrame:
        """Latest price of both sides per (terminal, commodity), one row each."""
        return self.prices_from(self.observations())

    @staticmethod
    def prices_from(observations: DataFrame) -> DataFrame:
        latest = F.struct("ts", "price", "stock", "status")
        wide = observations.groupBy("id_terminal", "id_commodity").agg(
            F.max(F.when(F.col("side") == "BUY", latest)).alias("b"),
            F.max(F.when(F.col("side") == "SELL", latest)).alias("s"),
            F.max("ts").alias("date_modified"),
        )
        return wide.select(
            "id_terminal",
            "id_commodity",
            F.col("b.price").alias("price_buy"),
            F.col("s.price").alias("price_sell"),
            F.col("b.stock").alias("scu_buy"),
            F.col("s.stock").alias("scu_sell_stock"),
            F.col("b.status").alias("status_buy"),
            F.col("s.status").alias("status_sell"),
            "date_modified",
        )

    # ---- catalogs ---------------------------------------------------------

    def terminals(self) -> DataFrame:
        sup = self.table("supplier")
        nat = self.table("nation")
        reg = self.table("region")
        part = self.table("part").select(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"))
        k = F.col("s_suppkey")
        name = title_words(F.col("p_name"))
        return (
            sup.join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(reg, nat.n_regionkey == reg.r_regionkey)
            .join(part, sup.s_suppkey == part.p_partkey, "left")
            .select(
                k.alias("id"),
                F.concat(name, F.lit(" Depot")).alias("name"),
                F.when(k % 4 == 0, F.lit(" "))
                .when(k % 4 == 1, F.concat(name, F.lit(" Depot")))
                .otherwise(F.concat(F.lit("Hub "), (k % 20).cast("string")))
                .alias("displayname"),
                F.concat(F.lit("T"), k.cast("string")).alias("nickname"),
                F.upper("p_brand").alias("code"),
                F.when(k % 10 == 9, "item").when(k % 2 == 0, "Commodity").otherwise("commodity").alias("type"),
                F.when(k % 5 == 2, F.concat(F.lit("City "), F.col("n_name"))).alias("city_name"),
                F.when(k % 5 == 3, F.concat(name, F.lit(" Outpost"))).alias("outpost_name"),
                F.when(k % 5 == 4, F.concat(name, F.lit(" Gateway ("), F.col("r_name"), F.lit(")"))).alias(
                    "space_station_name"
                ),
                F.when(k % 7 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("planet_name"),
                F.when(k % 11 != 0, F.col("r_name")).alias("star_system_name"),
                F.when(k % 3 == 0, 0).otherwise(F.col("n_nationkey")).alias("id_planet"),
                (k % 7).cast("int").alias("id_orbit"),
                F.when(F.col("s_acctbal") > -500, 1).otherwise(0).alias("is_visible"),
                F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("is_available_live"),
                F.col("n_nationkey").alias("place"),
                *[
                    F.when((k + i) % (i + 2) == 0, 0).otherwise(1).alias(flag)
                    for i, flag in enumerate(
                        ["has_loading_dock", "has_freight_elevator", "is_monitored", "is_space_station",
                         "is_on_ground", "has_refuel"]
                    )
                ],
            )
        )

    def commodities(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("code"),
            F.col("p_type").alias("kind"),
            F.when(size == 13, 0).otherwise(1).alias("is_visible"),
            F.when(F.col("p_type") == "PROMO", 1).otherwise(0).alias("is_illegal"),
            F.when(size % 4 == 0, F.lit(""))
            .when(size % 4 == 1, F.lit("1,2,4"))
            .when(size % 4 == 2, F.lit("8, 16,24,32"))
            .otherwise(F.lit("4,x,8,,-2,4"))
            .alias("container_sizes"),
        )

    def vehicles(self) -> DataFrame:
        n = F.substring_index("p_brand", "#", -1).cast("int")
        return (
            self.table("part")
            .groupBy(n.alias("id"), F.col("p_brand").alias("name"))
            .agg(F.max("p_size").cast("double").alias("size"))
            .select(
                "id",
                "name",
                F.when(F.col("id") % 6 == 0, 0.0).otherwise(F.col("size") + F.col("id") / 2.0).alias("scu"),
                F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("is_cargo"),
                F.when(F.col("id") % 3 == 0, F.lit(None).cast("string"))
                .when(F.col("id") % 3 == 1, F.lit("1,2"))
                .otherwise(F.lit("16,32,bad"))
                .alias("container_sizes"),
            )
        )

    # ---- payloads ---------------------------------------------------------

    def order_rows(self) -> DataFrame:
        """Lineitems numbered 0.. inside their order, in a stable order."""
        w = W.partitionBy("l_orderkey").orderBy(*ROW_ORDER)
        return self.table("lineitem").withColumn("row_index", F.row_number().over(w) - 1)

    def payloads(self) -> DataFrame:
        o = self.table("orders")
        p = F.col("o_orderpriority")
        return o.select(
            F.col("o_orderkey").alias("payload_id"),
            (F.floor(F.col("o_custkey") / 10) - 2).alias("id_terminal"),
            F.when(p == "1-URGENT", "Commodity").when(p == "5-LOW", "item").otherwise("commodity").alias("type"),
            F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(F.col("o_orderkey") % 2).cast("int").alias(
                "is_production"
            ),
            epoch_seconds(F.col("o_orderdate")).alias("sent_at"),
        )

    def payload_rows(self) -> DataFrame:
        price = unit_price()
        d, t = F.col("l_discount"), F.col("l_tax")
        told = (
            F.when(d == 0.10, price * 100000)
            .when(d == 0.09, F.lit(0.0))
            .when(d == 0.08, -price)
            .otherwise(price)
        )
        units = F.col("l_quantity").cast("int")
        scu = F.when(t == 0.01, units * 10000).when(t == 0.02, -units).otherwise(units)
        ln, flag = F.col("l_linenumber"), F.col("l_returnflag")
        status = F.when((ln == 7) & (flag == "R"), 8).when((ln == 1) & (flag == "R"), 0).otherwise(ln)
        nothing = t == 0.07
        buys = (F.col("l_linestatus") == "O") & ~nothing
        sells = ((F.col("l_linestatus") == "F") | (t == 0.08)) & ~nothing
        return self.order_rows().select(
            F.col("l_orderkey").alias("payload_id"),
            "row_index",
            F.when((ln == 7) & (F.col("l_partkey") % 10 == 0), F.col("l_partkey") + 10000000)
            .when(ln == 3, F.col("l_partkey") % 5)
            .otherwise(F.col("l_partkey"))
            .alias("id_commodity"),
            F.when(buys, told).alias("price_buy"),
            F.when(sells, told).alias("price_sell"),
            F.when(buys, scu).alias("scu_buy"),
            F.when(sells, scu).alias("scu_sell"),
            F.when(buys, status).alias("status_buy"),
            F.when(sells, status).alias("status_sell"),
            F.when(d < 0.05, 1).alias("is_missing"),
        )

    # ---- submission log ---------------------------------------------------

    def submissions(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        i = F.col("event_id")
        codes = F.array(*[F.lit(c) for c in SAMPLE_API_STATUSES])
        return e.select(
            i.alias("id"),
            epoch_seconds(F.col("ts")).alias("sent_at"),
            F.to_date("ts").alias("dt"),
            F.col("user_id").alias("id_terminal"),
            F.when(F.col("event_type") == "view", False).otherwise(True).alias("is_production"),
            (F.col("value") > 20).alias("ok"),
            F.when(F.col("value") > 20, 200)
            .when(F.col("event_type") == "error", (i % 4 + 499).cast("int"))
            .when(F.col("event_type") == "signup", 429)
            .otherwise(403)
            .alias("http_status"),
            F.when(F.col("value") > 20, "ok")
            .otherwise(F.element_at(codes, (i % len(SAMPLE_API_STATUSES) + 1).cast("int")))
            .alias("api_status"),
            (i % 5).cast("int").alias("attempt"),
            F.when(i % 13 == 0, F.lit(" "))
            .otherwise(F.concat(F.lit("Shot-"), (i % 500).cast("string"), F.lit(".png")))
            .alias("source_image"),
            F.when(i % 3 == 1, F.concat(F.lit('["SHOT-'), (i % 700).cast("string"), F.lit('.PNG","extra-'),
                                        (i % 50).cast("string"), F.lit('.jpg"," "]')))
            .when(i % 3 == 2, F.lit("not json"))
            .alias("source_images"),
            F.concat(F.lit("["), k.cast("string"), F.lit(","), (k + 1).cast("string"), F.lit("]")).alias(
                "submitted_commodity_ids"
            ),
        )

    # ---- captures ---------------------------------------------------------

    def captures(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        s = F.col("o_orderstatus")
        return o.select(
            k.alias("capture_id"),
            F.concat(F.lit("ScreenShot-"), k.cast("string"), F.lit(".jpg")).alias("source_image"),
            F.when(F.col("o_custkey") % 10 != 0, F.floor(F.col("o_custkey") / 15)).alias("id_terminal"),
            F.when(F.col("o_custkey") % 10 != 0, (70 + k % 31).cast("double")).alias("terminal_match_score"),
            (k % 4 == 0).alias("terminal_confirmed"),
            F.when(k % 2 == 0, 1920).otherwise(1280).alias("width"),
            F.when(k % 6 == 0, 800).when(k % 6 == 1, 1024).when(k % 6 == 2, 0).otherwise(720).alias("height"),
            F.when(s == "F", "BUY").when(s == "O", "SELL").otherwise("UNKNOWN").alias("tab"),
            F.when(k % 8 == 0, "PTU").otherwise("LIVE").alias("branch"),
            F.when(k % 9 == 0, F.lit(" 4.7.2 ")).when(k % 9 == 1, F.lit(" ")).alias("draft_version"),
            F.when(k % 10 == 0, True).when(k % 10 == 1, False).alias("draft_is_production"),
            epoch_seconds(F.col("o_orderdate")).alias("added_at"),
            F.when(k % 5 == 0, F.lit(0).cast("long")).otherwise(k).alias("queue_position"),
            F.concat(F.lit("batch-"), (F.col("o_custkey") % 50).cast("string")).alias("batch_id"),
            F.when(k % 3 == 0, F.lit("1,2,4")).when(k % 3 == 1, F.lit(" ")).alias("container_sizes"),
        )

    def capture_rows(self) -> DataFrame:
        pk, ln = F.col("l_partkey"), F.col("l_linenumber")
        price = unit_price()
        return self.order_rows().select(
            F.col("l_orderkey").alias("capture_id"),
            "row_index",
            F.when(~((ln == 7) & (pk % 3 == 0)), pk % 50).alias("id_commodity"),
            F.when(pk % 11 == 0, 0.0).otherwise((60 + (pk * 7) % 41).cast("double")).alias("match_score"),
            F.when(F.col("l_discount") == 0.1, F.lit(None)).when(F.col("l_discount") == 0.09, 0.0).otherwise(price).alias("price"),
            F.when(F.col("l_tax") == 0.08, F.lit(None)).when(F.col("l_tax") == 0.07, 0).otherwise(
                F.col("l_quantity").cast("int")).alias("scu"),
            F.when(F.col("l_returnflag") == "N", 0).otherwise(ln).alias("status"),
        )

    # ---- text lines -------------------------------------------------------

    def screen_lines(self) -> DataFrame:
        """Noisy price-terminal text, several lines per lineitem, derived by rule."""
        part = self.table("part").select("p_partkey", "p_name")
        # joined first, so that lines stay dealt by order; rows without a part count for the numbers
        w = W.partitionBy("l_orderkey").orderBy(*ROW_ORDER)
        named = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        rows = named.withColumn("row_index", F.row_number().over(w) - 1).filter("p_partkey is not null")
        k, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        up = F.upper("p_name")
        first, second = F.split_part(up, F.lit(" "), F.lit(1)), F.split_part(up, F.lit(" "), F.lit(2))
        name = (
            F.when(pk % 6 == 0, F.array(up))
            .when(pk % 6 == 1, F.array(title_words(F.col("p_name"))))
            .when(pk % 6 == 2, F.array(F.translate(up, "O", "0")))
            .when(pk % 6 == 3, F.array(F.translate(up, "I", "1")))
            .when(pk % 6 == 4, F.array(first, second))
            .otherwise(F.array(F.concat(up, F.lit("X"))))
        )
        status = F.element_at(F.array(*[F.lit(s) for s in SAMPLE_STATUS_LINES]), ln)
        q = F.col("l_quantity").cast("int").cast("string")
        scu = (
            F.when(F.col("l_returnflag") == "A", F.concat(q, F.lit(" SCU")))
            .when(F.col("l_returnflag") == "R", F.concat(q, F.lit(",300 SCU")))
            .when(ln >= 6, F.lit("OSCU"))
            .otherwise(F.concat(q, F.lit("O SCU")))
        )
        price = F.when(F.col("l_linestatus") == "F", F.concat(q, F.lit(".5K/SCU"))).otherwise(
            F.concat(F.floor(unit_price()).cast("string"), F.lit("/SCU"))
        )
        none = F.array().cast("array<string>")
        head = F.when(F.col("row_index") == 0,
                      F.when(k % 3 == 0, F.array(F.lit("SHOP INVENTORY"), F.lit("BUY")))
                      .when(k % 3 == 1, F.array(F.lit("LOCAL MARKET VALUE"), F.lit("IN STOCK")))
                      .otherwise(F.array(F.lit("BUY"), F.lit("LOCAL MARKET VALUE")))).otherwise(none)
        mark = F.when(k % 5 == 0, F.array(F.lit("--- ROW ---"))).otherwise(none)
        early = F.when(k % 4 == 0, F.array(status)).otherwise(none)
        late = F.when(k % 4 == 0, none).otherwise(F.array(status))
        cargo = F.when(k % 3 == 0, F.array(
            F.lit("AVAILABLE CARGO SIZE (SCU)"),
            F.when(ln % 2 == 0, F.lit("1 2 4 8 16")).otherwise(F.lit("8 16 24 32")))).otherwise(none)
        lines = F.concat(head, mark, early, name, late, F.array(F.lit("SHOP QUANTITY"), scu, price), cargo)
        return rows.select(k.alias("capture_id"), "row_index", F.posexplode(lines).alias("pos", "text")).select(
            "capture_id", (F.col("row_index") * 20 + F.col("pos")).cast("long").alias("line_no"), "text"
        )

    def document_lines(self) -> DataFrame:
        """Whole documents split into trimmed, non-empty lines; line_no counts raw lines."""
        d = widen(self.table("documents").select("doc_id", "text"))
        return split_lines(d.select(F.col("doc_id").alias("capture_id"), "text"))


def split_lines(df: DataFrame) -> DataFrame:
    """(capture_id, text) to one row per trimmed non-empty line."""
    from tradeq.functions.text import strip

    parts = df.select("capture_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return parts.select("capture_id", F.col("line_no").cast("long").alias("line_no"), strip(F.col("raw")).alias("text")).filter(
        "text <> ''"
    )


# Fixed sample values used when the given tables are turned into log and screen text.
SAMPLE_API_STATUSES = ["too_many_reports", "Duplicated_Report", "not_allowed", "missing_secret_key", "weird_code"]
SAMPLE_STATUS_LINES = [
    "MAX INVENTORY",
    "VERY HIGH INVENTORY",
    "High. Inventory",
    "Medsum Inventory",
    "L0W INVENTORY",
    "QUT DE STOCK",
    "OUT OF STOCH",
]
