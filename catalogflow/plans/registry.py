"""Registered queries, each with its SQL where there is any, and the relations they start from.

The relations of a point-event catalog (picks, origins, readings, located events, stations, epochs) are
derived from the driver's tables; RELATIONS has the same derivations in DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as tm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RELATIONS = {
    "picks": "SELECT event_id AS pick_id, 'KG.U' || user_id AS station, event_type AS phase, epoch_us(ts) AS us, ts, least(value / 500, 1.0) AS prob FROM events",
    "origins": "SELECT event_id AS idx, epoch_us(ts) AS us, ts, 128 + (event_id % 997) / 997.0::DOUBLE AS lon, 35 + (event_id * 7 % 991) / 991.0::DOUBLE AS lat, (event_id * 13 % 211) / 10.0::DOUBLE AS dep FROM events WHERE event_type = 'purchase'",
    "readings": "SELECT l_orderkey AS event_idx, l_linenumber AS line, l_suppkey AS unit, log10(l_extendedprice) AS ml, l_quantity AS snr, l_shipdate AS ts, l_partkey % 120 AS dist, l_extendedprice AS peak FROM lineitem",
    "catalog": "SELECT o_orderkey AS idx, o_orderdate AS ts, epoch_us(o_orderdate) AS us, log10(o_totalprice) AS mag, o_orderpriority AS zone, o_orderstatus AS state, 128 + (o_orderkey % 997) / 997.0::DOUBLE AS lon, 35 + (o_orderkey * 7 % 991) / 991.0::DOUBLE AS lat, (o_orderkey * 13 % 211) / 10.0::DOUBLE AS dep FROM orders",
    "located": "SELECT o_orderkey AS idx, (o_orderkey % 113) / 10.0::DOUBLE AS erh, (o_orderkey % 97) / 10.0::DOUBLE AS erz, (o_orderkey * 17 % 3600) / 10.0::DOUBLE AS gap, o_orderkey % 20 AS num, CASE WHEN o_orderkey % 41 <> 0 THEN (o_orderkey % 31) / 20.0::DOUBLE END AS rms FROM orders",
    "stations": "SELECT s_suppkey AS id, 'S' || s_suppkey AS sta, s_nationkey AS net, 35 + (s_suppkey * 37 % 100) / 100.0::DOUBLE AS lat, 128 + (s_suppkey * 53 % 100) / 100.0::DOUBLE AS lon, (s_suppkey * 7 % 500)::DOUBLE AS elev, s_acctbal AS bal FROM supplier",
    "epochs": "SELECT user_id, 'U' || user_id AS base, 'U' || user_id || 'abc'[k + 1] AS value, epoch_us(TIMESTAMP '2024-01-01') + (user_id % 5 + k * 10) * 86400000000 AS t0, epoch_us(TIMESTAMP '2024-01-01') + (user_id % 5 + (k + 1) * 10) * 86400000000 AS t1 FROM (SELECT DISTINCT user_id FROM events WHERE value > 150), range(2) r(k)",
}


def with_(names: str, body: str) -> str:
    """SQL over the named relations."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names.split()) + " " + body


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def picks(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pick_id"), F.concat(F.lit("KG.U"), F.col("user_id").cast("string")).alias("station"), F.col("event_type").alias("phase"), tm.micros(F.col("ts")).alias("us"), "ts", F.least(F.col("value") / 500, F.lit(1.0)).alias("prob"))


def _coords(id: str) -> list:
    i = F.col(id)
    return [(128 + (i % 997) / 997.0).alias("lon"), (35 + (i * 7 % 991) / 991.0).alias("lat"), ((i * 13 % 211) / 10.0).alias("dep")]


def origins(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("idx"), tm.micros(F.col("ts")).alias("us"), "ts", *_coords("event_id"))


def readings(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("event_idx"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("unit"), F.log10("l_extendedprice").alias("ml"), F.col("l_quantity").alias("snr"), F.col("l_shipdate").alias("ts"), (F.col("l_partkey") % 120).alias("dist"), F.col("l_extendedprice").alias("peak"))


def catalog(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderdate").alias("ts"), tm.micros(F.col("o_orderdate")).alias("us"), F.log10("o_totalprice").alias("mag"), F.col("o_orderpriority").alias("zone"), F.col("o_orderstatus").alias("state"), *_coords("o_orderkey"))


def located(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("idx"), (k % 113 / 10.0).alias("erh"), (k % 97 / 10.0).alias("erz"), (k * 17 % 3600 / 10.0).alias("gap"), (k % 20).alias("num"), F.when(k % 41 != 0, k % 31 / 20.0).alias("rms"))


def stations(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("S"), k.cast("string")).alias("sta"), F.col("s_nationkey").alias("net"), (35 + k * 37 % 100 / 100.0).alias("lat"), (128 + k * 53 % 100 / 100.0).alias("lon"), (k * 7 % 500).cast("double").alias("elev"), F.col("s_acctbal").alias("bal"))


def epochs(spark, d) -> DataFrame:
    u = table(spark, d, "events").filter("value > 150").select("user_id").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    start, day = F.lit(1704067200000000), F.lit(tm.DAY_US)
    base = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return u.select("user_id", base.alias("base"), F.concat(base, F.char(F.col("k") + 97)).alias("value"), (start + (F.col("user_id") % 5 + F.col("k") * 10) * day).alias("t0"), (start + (F.col("user_id") % 5 + (F.col("k") + 1) * 10) * day).alias("t1"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)
