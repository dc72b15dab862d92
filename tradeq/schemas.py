"""Explicit schemas of the files read and written."""

from __future__ import annotations

from pyspark.sql import types as T

ENVELOPE = "status string, message string, http_code int, data string"

COMMODITY = (
    "id int, name string, code string, kind string, is_visible int, is_buyable int, is_sellable int, "
    "is_available_live int, is_illegal int"
)

TERMINAL = (
    "id int, name string, displayname string, nickname string, code string, slug string, type string, "
    "id_star_system int, id_planet int, id_orbit int, id_moon int, id_space_station int, id_city int, id_outpost int, "
    "star_system_name string, planet_name string, orbit_name string, moon_name string, space_station_name string, "
    "outpost_name string, city_name string, is_visible int, is_available_live int"
)

VEHICLE = (
    "id int, id_company int, name string, name_full string, slug string, scu double, container_sizes string, "
    "is_cargo int, is_spaceship int, is_ground_vehicle int, is_loading_dock int, is_concept int, pad_type string, "
    "game_version string, company_name string"
)

PRICE = (
    "id int, id_commodity int, id_terminal int, price_buy double, price_sell double, scu_buy double, "
    "scu_sell_stock double, status_buy int, status_sell int, date_added bigint, date_modified bigint, "
    "commodity_name string, terminal_name string"
)

SUBMISSION = (
    "id bigint, sent_at bigint, id_terminal bigint, is_production boolean, ok boolean, http_status int, "
    "api_status string, source_image string, source_images string, submitted_commodity_ids string, dt date"
)

GROUND_TRUTH = (
    "image string, terminal string, terminalType string, "
    "rows array<struct<commodity:string,quantity:string,price:string>>, expectedText string"
)

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
