"""Domain tables as deterministic expressions of the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.sources.readers import table


def place(key: str, a: int, b: int, a_mod: int = 1000, b_mod: int = 200):
    return (F.lit(54.0) + F.pmod(F.col(key) * a, F.lit(a_mod)) / float(a_mod)), (F.lit(24.0) + F.pmod(F.col(key) * b, F.lit(b_mod)) / float(b_mod))


def place_sql(key: str, a: int, b: int, a_mod: int = 1000, b_mod: int = 200) -> str:
    return f"54.0::DOUBLE + (({key} * {a}) % {a_mod}) / {a_mod}::DOUBLE AS lon, 24.0::DOUBLE + (({key} * {b}) % {b_mod}) / {b_mod}::DOUBLE AS lat"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = place("event_id", 37, 13)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("track_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("class"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"), F.pmod("event_id", F.lit(50)).alias("pass_id"), "value", "props", lon.alias("lon"), lat.alias("lat"),
    )


DET = f"""det AS (SELECT event_id AS id, user_id AS track_id, ts AS created_at, event_type AS class, least(1.0::DOUBLE, value / 500) AS confidence,
  event_id % 50 AS pass_id, value, props, {place_sql("event_id", 37, 13)} FROM events)"""


def track_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("point_id"),
        (F.lit(54.0) + F.floor(F.col("value") / 20) * F.lit(0.02) + F.lit(0.005)).alias("lon"), (F.lit(24.0) + F.length("event_type") * F.lit(0.02) + F.lit(0.005)).alias("lat"),
    )


POINTS = """pts AS (SELECT user_id AS track_id, ts AS observed_at, event_id AS point_id,
  54.0::DOUBLE + floor(value / 20) * 0.02::DOUBLE + 0.005::DOUBLE AS lon, 24.0::DOUBLE + length(event_type) * 0.02::DOUBLE + 0.005::DOUBLE AS lat FROM events)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = place("s_suppkey", 83, 29)
    kind = F.element_at(F.array(F.lit("base"), F.lit("launchpoint"), F.lit("facility")), (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int"))
    radius = F.when(kind == "base", 5000.0).when(kind == "launchpoint", 2000.0).otherwise(1000.0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("site_name"), kind.alias("kind"), radius.alias("radius_m"), lon.alias("lon"), lat.alias("lat"))


SITES = f"""sites AS (SELECT s_suppkey AS site_id, s_name AS site_name, ['base', 'launchpoint', 'facility'][s_suppkey % 3 + 1] AS kind,
  [5000.0, 2000.0, 1000.0][s_suppkey % 3 + 1]::DOUBLE AS radius_m, {place_sql("s_suppkey", 83, 29)} FROM supplier)"""


def targets(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = place("p_partkey", 61, 17)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), lon.alias("lon"), lat.alias("lat"))


TARGETS = f"targets AS (SELECT p_partkey AS target_id, p_name AS name, p_type AS type, {place_sql('p_partkey', 61, 17)} FROM part)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.pmod("l_partkey", F.lit(500)).cast("double"), F.pmod("l_suppkey", F.lit(500)).cast("double")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"), F.pmod("l_orderkey", F.lit(2000)).alias("image"), F.col("l_returnflag").alias("cls"),
        F.element_at(F.array(F.lit("sam3"), F.lit("dota_obb"), F.lit("yoloe")), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int")).alias("source"),
        x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") + 5).alias("x2"), (y + F.col("l_quantity") * 0.5 + 5).alias("y2"),
        (F.lit(1.0) - F.col("l_discount") - F.col("l_tax")).alias("confidence"), F.pmod("l_linenumber", F.lit(7)).alias("frame"),
    )


BOXES = """boxes AS (SELECT l_orderkey * 10 + l_linenumber AS det_id, l_orderkey % 2000 AS image, l_returnflag AS cls, ['sam3', 'dota_obb', 'yoloe'][l_suppkey % 3 + 1] AS source,
  (l_partkey % 500)::DOUBLE AS x1, (l_suppkey % 500)::DOUBLE AS y1, (l_partkey % 500)::DOUBLE + l_quantity + 5 AS x2, (l_suppkey % 500)::DOUBLE + l_quantity * 0.5::DOUBLE + 5 AS y2,
  1.0::DOUBLE - l_discount - l_tax AS confidence, l_linenumber % 7 AS frame FROM lineitem)"""


def supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")).distinct()


EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem), links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"


def supply_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).unionByName(table(spark, sf, "part").select((F.col("p_partkey") + 10_000_000).alias("id")))


NODES = "nodes AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + 10000000 FROM part)"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    s = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, {s}))))"


def iou_sql(a: str, b: str) -> str:
    w, h = (f"greatest(0, least({a}.{c}2, {b}.{c}2) - greatest({a}.{c}1, {b}.{c}1))" for c in "xy")
    area = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    return f"({w} * {h} / ({area(a)} + {area(b)} - {w} * {h}))"
