"""Aggregations (A), scans and sinks (S, K), scalar functions (X) and graphs (C) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..functions import time as tm
from ..operators import blocks, graph, robust, stats
from ..sources import records, tables
from .registry import catalog, epochs, located, origins, picks, query, r6, readings, stations, table, with_

LN10 = "2.302585092994046"


@query("a01_pick_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS n_p, count(*) FILTER (event_type = 'click') AS n_s FROM events GROUP BY 1")
def a01(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("n_p"), F.count_if(F.col("event_type") == "click").alias("n_s"))


@query("a03_event_magnitudes", with_("readings", "SELECT event_idx, round(quantile_cont(ml, 0.5), 6) AS magnitude, round(avg(ml), 6) AS mean, round(stddev_samp(ml), 6) AS std, count(ml) AS n_used, count(*) AS n_total, round(quantile_cont(snr, 0.5), 6) AS snr, CASE WHEN count(ml) >= 3 THEN 'ok' ELSE 'low_snr' END AS status FROM (SELECT * REPLACE (CASE WHEN dist <= 60 THEN ml END AS ml) FROM readings WHERE snr >= 2) GROUP BY 1"))
def a03(s, d):
    from .magnitudes import event_magnitudes

    m = event_magnitudes(readings(s, d), cap=60, least=3)
    return m.select("event_idx", *[r6(F.col(c), c) for c in ("magnitude", "mean", "std")], "n_used", "n_total", r6(F.col("snr"), "snr"), "status")


@query("a04_distinct_stations", "SELECT l_orderkey AS event_idx, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def a04(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_idx")).agg(F.count_distinct("l_suppkey").alias("n"))


@query("a05_first_value", with_("readings", "SELECT event_idx, arg_min(unit, line * 1000000 + unit) AS unit FROM readings GROUP BY 1"))
def a05(s, d):
    return readings(s, d).groupBy("event_idx").agg(F.min(F.struct("line", "unit")).alias("m")).select("event_idx", "m.unit")


@query("a06_residuals", with_("readings", "SELECT event_idx, line, round(ml - quantile_cont(ml, 0.5) OVER (PARTITION BY event_idx), 6) AS residual FROM readings"))
def a06(s, d):
    w = Window.partitionBy("event_idx")
    return readings(s, d).select("event_idx", "line", r6(F.col("ml") - F.percentile("ml", 0.5).over(w), "residual"))


def polish(middle: str, rounds: int, tolerance: float) -> str:
    """The alternating middles of :mod:`robust`, round by round, up to the first in which no level moves."""
    steps = ", l0 AS MATERIALIZED (SELECT event_idx, {m} AS level FROM (SELECT event_idx, ml AS v FROM readings) GROUP BY 1)".format(m=middle)
    for k in range(1, rounds + 1):
        steps += f", r{k} AS MATERIALIZED (SELECT unit, {middle} AS raw, count(*) AS n FROM (SELECT unit, ml - level AS v FROM readings JOIN l{k - 1} USING (event_idx)) GROUP BY 1)"
        steps += f", f{k} AS MATERIALIZED (SELECT unit, raw - (SELECT sum(raw * n) / sum(n) FROM r{k}) AS c FROM r{k})"
        steps += f", l{k} AS MATERIALIZED (SELECT event_idx, {middle} AS level FROM (SELECT event_idx, ml - c AS v FROM readings JOIN f{k} USING (unit)) GROUP BY 1)"
        steps += f", m{k} AS MATERIALIZED (SELECT max(abs(a.level - b.level)) AS m FROM l{k} a JOIN l{k - 1} b USING (event_idx))"
    moved = " UNION ALL ".join(f"SELECT {k} AS k, m FROM m{k}" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, unit, c FROM f{k}" for k in range(1, rounds + 1))
    return f"{steps}, z AS (SELECT coalesce(min(k) FILTER (m < {tolerance}), {rounds}) AS k FROM ({moved})), f AS ({every})"


@query("a07_median_polish", with_("readings", polish("quantile_cont(v, 0.5)", 40, 1e-4) + " SELECT unit, round(c, 6) AS correction FROM f JOIN z USING (k)"))
def a07(s, d):
    return robust.median_polish(readings(s, d), event="event_idx", unit="unit", value="ml")[1].select("unit", r6(F.col("correction"), "correction"))


@query("a08_two_way_means", with_("readings", polish("avg(v)", 40, 1e-9) + " SELECT unit, round(c, 6) AS correction FROM f JOIN z USING (k)"))
def a08(s, d):
    return robust.two_way_means(readings(s, d), event="event_idx", unit="unit", value="ml")[1].select("unit", r6(F.col("correction"), "correction"))


@query("a09_monthly_medians", with_("readings", "SELECT unit, strftime(date_trunc('month', ts), '%Y-%m') AS month, round(quantile_cont(ml, 0.5), 6) AS med, count(*) AS n FROM readings GROUP BY ALL HAVING count(*) >= 8"))
def a09(s, d):
    return readings(s, d).groupBy("unit", F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month")).agg(F.round(F.percentile("ml", 0.5), 6).alias("med"), F.count("*").alias("n")).filter("n >= 8")


@query("a10_annual_counts", "SELECT y::INTEGER AS year, count(o_orderkey) AS n FROM range(1990, 2011) r(y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1")
def a10(s, d):
    spine = s.range(1990, 2011).select(F.col("id").cast("int").alias("year"))
    n = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return spine.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


@query("a11_annual_medians", with_("readings", "SELECT year(ts)::INTEGER AS year, round(quantile_cont(ml, 0.5), 6) AS ml, round(quantile_cont(snr, 0.5), 6) AS snr, count(*) AS n FROM readings GROUP BY 1"))
def a11(s, d):
    return readings(s, d).groupBy(F.year("ts").alias("year")).agg(F.round(F.percentile("ml", 0.5), 6).alias("ml"), F.round(F.percentile("snr", 0.5), 6).alias("snr"), F.count("*").alias("n"))


@query("a12_two_anchors", with_("readings", "SELECT event_idx, round(quantile_cont(ml, 0.5), 6) AS ml FROM readings JOIN supplier ON s_suppkey = unit AND s_acctbal > 5000 GROUP BY 1 HAVING count(DISTINCT unit) >= 2"))
def a12(s, d):
    anchors = table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("unit"))
    return readings(s, d).join(anchors, "unit", "left_semi").groupBy("event_idx").agg(F.round(F.percentile("ml", 0.5), 6).alias("ml"), F.count_distinct("unit").alias("u")).filter("u >= 2").drop("u")


@query("a13_binned", with_("readings", "SELECT ceil(dist / 20.0)::BIGINT AS bin, round(quantile_cont(ml, 0.5), 6) AS med, round(stddev_samp(ml), 6) AS std, count(*) AS n FROM readings WHERE dist > 0 GROUP BY 1"))
def a13(s, d):
    return readings(s, d).filter("dist > 0").groupBy(F.ceil(F.col("dist") / 20.0).alias("bin")).agg(F.round(F.percentile("ml", 0.5), 6).alias("med"), F.round(F.stddev_samp("ml"), 6).alias("std"), F.count("*").alias("n"))


@query("a14_contingency", with_("catalog", ", c AS (SELECT zone, year(ts) >= 1998 AS late, count(*)::DOUBLE AS n FROM catalog GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY zone) * sum(n) OVER (PARTITION BY late) / sum(n) OVER () AS e FROM c) SELECT zone, late, round((n - e) / sqrt(e), 6) AS residual, round(sum((n - e) ** 2 / e) OVER (), 6) AS chi2 FROM t"))
def a14(s, d):
    c = catalog(s, d).groupBy("zone", (F.year("ts") >= 1998).alias("late")).agg(F.count("*").cast("double").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    t = c.withColumn("e", over("zone") * over("late") / over())
    return t.select("zone", "late", r6((F.col("n") - F.col("e")) / F.sqrt("e"), "residual"), r6(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).over(Window.partitionBy()), "chi2"))


@query("a15_size_distribution", with_("catalog", ", c AS (SELECT zone, round_even(mag * 10, 0)::INTEGER AS m10, count(*) AS n FROM catalog GROUP BY ALL) SELECT zone, m10, n, sum(n) OVER (PARTITION BY zone ORDER BY m10 DESC)::BIGINT AS n_cum FROM c"))
def a15(s, d):
    return stats.size_distribution(catalog(s, d), magnitude="mag", keys=["zone"])


@query("a16_density", with_("catalog", "SELECT floor(lon / 0.05)::BIGINT AS gx, floor(lat / 0.05)::BIGINT AS gy, count(*) AS n FROM catalog GROUP BY ALL"))
def a16(s, d):
    return catalog(s, d).groupBy(F.floor(F.col("lon") / 0.05).alias("gx"), F.floor(F.col("lat") / 0.05).alias("gy")).agg(F.count("*").alias("n"))


@query("a17_smoothed_density", with_("catalog", ", g AS (SELECT floor(lon / 0.05)::BIGINT AS gx, floor(lat / 0.05)::BIGINT AS gy, count(*) AS n FROM catalog GROUP BY ALL), k AS (SELECT x::BIGINT AS dx, y::BIGINT AS dy, exp(-(x * x + y * y) / 2.0) AS w FROM range(-2, 3) a(x), range(-2, 3) b(y)) SELECT gx + dx AS gx, gy + dy AS gy, round(sum(n * w) / (SELECT sum(w) FROM k), 6) AS n FROM g, k GROUP BY ALL"))
def a17(s, d):
    import math

    kernel = {(x, y): math.exp(-(x * x + y * y) / 2) for x in range(-2, 3) for y in range(-2, 3)}
    g = catalog(s, d).groupBy(F.floor(F.col("lon") / 0.05).alias("gx"), F.floor(F.col("lat") / 0.05).alias("gy")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w")) for (x, y), w in kernel.items())))
    return g.withColumn("k", cells).groupBy((F.col("gx") + F.col("k.x")).alias("gx"), (F.col("gy") + F.col("k.y")).alias("gy")).agg(F.round(F.sum(F.col("n") * F.col("k.w")) / sum(kernel.values()), 6).alias("n"))


@query("a18_completeness", with_("catalog", ", c AS (SELECT zone, round_even(mag * 10, 0)::INTEGER AS m10, count(*) AS n FROM catalog GROUP BY ALL) SELECT zone, round(m10 / 10.0::DOUBLE + 0.2, 6) AS mc FROM c QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, m10) = 1"))
def a18(s, d):
    return stats.completeness(catalog(s, d), magnitude="mag", keys=["zone"])


@query("a20_b_value", with_("catalog", f"SELECT zone, round(1 / ({LN10} * (avg(mag) - 5.0 + 0.05)), 6) AS b, count(*) AS n FROM catalog WHERE mag >= 5.0 GROUP BY 1"))
def a20(s, d):
    return catalog(s, d).filter("mag >= 5.0").groupBy("zone").agg(F.round(stats.b_value(F.col("mag"), 5.0), 6).alias("b"), F.count("*").alias("n"))


@query("a21_b_positive", with_("catalog", f", x AS (SELECT zone, round(mag - lag(mag) OVER (PARTITION BY zone ORDER BY us, idx), 6) AS d FROM catalog) SELECT zone, count(*) AS n, round(1 / ({LN10} * (avg(d) - 0.1 + 0.05)), 6) AS b FROM x WHERE d >= 0.1 GROUP BY 1"))
def a21(s, d):
    return stats.b_positive(catalog(s, d).select("idx", "zone", "us", "mag"), magnitude="mag", at="us", id="idx", width=30 * tm.DAY_US, keys=["zone"]).select("zone", "n", r6(F.col("b"), "b"))


@query("a22_cutoff_ladder", with_("catalog", f", k AS (SELECT (45 + k)::INTEGER AS c10 FROM range(10) r(k)) SELECT zone, c10, count(*) AS n, round(1 / ({LN10} * (avg(mag) - c10 / 10.0::DOUBLE + 0.05)), 6) AS b FROM catalog JOIN k ON mag >= c10 / 10.0::DOUBLE GROUP BY zone, c10"))
def a22(s, d):
    at = F.explode(F.filter(F.sequence(F.lit(45), F.lit(54)), lambda c: F.col("mag") >= c / F.lit(10.0)))
    return catalog(s, d).withColumn("c10", at).groupBy("zone", "c10").agg(F.count("*").alias("n"), F.round(1 / (stats.LN10 * (F.avg("mag") - F.first("c10") / 10.0 + 0.05)), 6).alias("b"))


@query("a23_detection_model")
def a23(s, d):
    h = stats.size_distribution(catalog(s, d), magnitude="mag", keys=["zone"])
    return robust.detection_model(h, keys=["zone"], boots=20)


@query("a24_detected_share", with_("catalog", ", c AS (SELECT round_even(mag * 10, 0)::INTEGER AS m10, count(*) AS n FROM catalog GROUP BY 1), t AS (SELECT m10, n, sum(n) OVER (ORDER BY m10 DESC) AS cum FROM c), f AS (SELECT regr_slope(log10(cum), m10) AS a, regr_intercept(log10(cum), m10) AS b FROM t WHERE m10 BETWEEN 50 AND 55) SELECT m10, round(cum / power(10.0, a * m10 + b), 6) AS share FROM t, f"))
def a24(s, d):
    t = stats.size_distribution(catalog(s, d), magnitude="mag")
    f = t.filter("m10 BETWEEN 50 AND 55").agg(F.regr_slope(F.log10("n_cum"), F.col("m10")).alias("a"), F.regr_intercept(F.log10("n_cum"), F.col("m10")).alias("b")).first()
    return t.select("m10", r6(F.col("n_cum") / F.pow(F.lit(10.0), F.lit(f.a) * F.col("m10") + F.lit(f.b)), "share"))


@query("a25_rate_ratio", with_("catalog", "SELECT zone, count(*) FILTER (year(ts) < 1998) AS n1, count(*) FILTER (year(ts) >= 1998) AS n2, round((count(*) FILTER (year(ts) >= 1998) / 3.6::DOUBLE) / (count(*) FILTER (year(ts) < 1998) / 3.0::DOUBLE), 6) AS ratio FROM catalog GROUP BY 1"))
def a25(s, d):
    n1, n2 = F.count_if(F.year("ts") < 1998), F.count_if(F.year("ts") >= 1998)
    return catalog(s, d).groupBy("zone").agg(n1.alias("n1"), n2.alias("n2"), F.round((n2 / 3.6) / (n1 / 3.0), 6).alias("ratio"))


@query("a26_ratio_by_threshold", with_("catalog", ", k AS (SELECT (45 + k)::INTEGER AS c10 FROM range(10) r(k)), c AS (SELECT c10, count(*) FILTER (year(ts) < 1998)::DOUBLE AS n1, count(*) FILTER (year(ts) >= 1998)::DOUBLE AS n2 FROM catalog JOIN k ON mag >= c10 / 10.0::DOUBLE GROUP BY 1) SELECT c10, round(n2 / n1, 6) AS ratio, round(n2 / n1 * exp(-1.96 * sqrt(1 / n1 + 1 / n2)), 6) AS low, round(n2 / n1 * exp(1.96 * sqrt(1 / n1 + 1 / n2)), 6) AS high FROM c"))
def a26(s, d):
    at = F.explode(F.filter(F.sequence(F.lit(45), F.lit(54)), lambda c: F.col("mag") >= c / F.lit(10.0)))
    c = catalog(s, d).withColumn("c10", at).groupBy("c10").agg(F.count_if(F.year("ts") < 1998).alias("n1"), F.count_if(F.year("ts") >= 1998).alias("n2"))
    ratio, half = F.col("n2") / F.col("n1"), 1.96 * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))
    return c.select("c10", r6(ratio, "ratio"), r6(ratio * F.exp(-half), "low"), r6(ratio * F.exp(half), "high"))


@query("a27_uniformity", with_("catalog", ", c AS (SELECT zone, year(ts) AS y, count(*)::DOUBLE AS n, CASE WHEN year(ts) = 2001 THEN 213 / 365.0::DOUBLE ELSE 1 END AS w FROM catalog GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY zone) * w / sum(w) OVER (PARTITION BY zone) AS e FROM c) SELECT zone, round(sum((n - e) ** 2 / e), 6) AS chi2, count(*) AS k FROM t GROUP BY 1"))
def a27(s, d):
    c = catalog(s, d).groupBy("zone", F.year("ts").alias("y")).agg(F.count("*").alias("n")).withColumn("w", F.when(F.col("y") == 2001, 213 / 365.0).otherwise(1.0))
    over = lambda x: F.sum(x).over(Window.partitionBy("zone"))
    return c.withColumn("e", over("n") * F.col("w") / over("w")).groupBy("zone").agg(F.round(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")), 6).alias("chi2"), F.count("*").alias("k"))


@query("a28_fdr", "WITH p AS (SELECT n_nationkey AS id, (n_nationkey * 37 % 101) / 101.0::DOUBLE AS p FROM nation), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw, row_number() OVER (ORDER BY p, id) AS rank FROM p) SELECT id, rank, round(least(1.0, min(raw) OVER (ORDER BY rank DESC)), 6) AS q FROM r")
def a28(s, d):
    p = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 37 % 101 / 101.0).alias("p"))
    return stats.benjamini_hochberg(p, p="p", id="id").select("id", "rank", r6(F.col("q"), "q"))


PHASE = "(epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE * 2 * pi()"


@query("a29_circular", f"SELECT event_type, count(*) AS n, round(sqrt(sum(cos({PHASE})) ** 2 + sum(sin({PHASE})) ** 2), 4) AS resultant, round(exp(-(sum(cos({PHASE})) ** 2 + sum(sin({PHASE})) ** 2) / count(*)), 6) AS p FROM events GROUP BY 1")
def a29(s, d):
    import math

    phase = F.pmod(tm.micros(F.col("ts")), F.lit(tm.DAY_US)) / 86400000000.0 * 2 * math.pi
    c = table(s, d, "events").groupBy("event_type").agg(*stats.circular(phase))
    return c.select("event_type", "n", F.round("resultant", 4).alias("resultant"), r6(F.col("p"), "p"))


@query("a30_cluster_hours", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN (hour(ts) + 9) % 24 BETWEEN 7 AND 18 THEN 1.0 ELSE 0 END), 6) AS daytime, round(avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0 END) / (2 / 7.0::DOUBLE), 6) AS weekend, round(quantile_cont(value, 0.5), 6) AS med FROM events GROUP BY 1")
def a30(s, d):
    local = (F.hour("ts") + 9) % 24
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(local.between(7, 18), 1.0).otherwise(0.0)), 6).alias("daytime"), F.round(F.avg(F.when(tm.is_weekend(F.col("ts")), 1.0).otherwise(0.0)) / (2 / 7.0), 6).alias("weekend"), F.round(F.percentile("value", 0.5), 6).alias("med"))


@query("a31_grid_declustering", with_("origins", ", g AS (SELECT *, floor(lon / 0.1)::BIGINT AS gx, floor(lat / 0.1)::BIGINT AS gy, (hour(ts) + 9) % 24 BETWEEN 7 AND 18 AS day FROM origins), b AS (SELECT gx, gy FROM g GROUP BY ALL HAVING count(*) >= 10 AND avg(day::INTEGER) >= 0.6) SELECT idx FROM g WHERE NOT (day AND EXISTS (SELECT 1 FROM b WHERE b.gx = g.gx AND b.gy = g.gy))"))
def a31(s, d):
    g = origins(s, d).withColumn("gx", F.floor(F.col("lon") / 0.1)).withColumn("gy", F.floor(F.col("lat") / 0.1)).withColumn("day", ((F.hour("ts") + 9) % 24).between(7, 18))
    bad = g.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.avg(F.col("day").cast("int")).alias("share")).filter("n >= 10 AND share >= 0.6").select("gx", "gy", F.lit(True).alias("bad"))
    return g.join(bad, ["gx", "gy"], "left").filter("NOT (day AND coalesce(bad, false))").select("idx")


@query("a33_recurrence", "WITH i AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 8.64e10 AS dt FROM events) SELECT user_id, count(*) AS n, round(quantile_cont(dt, 0.5), 6) AS recurrence, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 8.64e10, 6) AS span FROM i GROUP BY 1")
def a33(s, d):
    us = tm.micros(F.col("ts"))
    e = table(s, d, "events").withColumn("us", us).withColumn("dt", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 8.64e10)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.percentile("dt", 0.5), 6).alias("recurrence"), F.round((F.max("us") - F.min("us")) / 8.64e10, 6).alias("span"))


@query("a34_spread", with_("catalog", ", c AS (SELECT zone, state, avg(lon) AS x, avg(lat) AS y FROM catalog GROUP BY ALL) SELECT zone, state, round(sqrt(avg((lon - x) ** 2 + (lat - y) ** 2)), 6) AS rms, round(stddev_samp(dep), 6) AS depth_std, count(*) AS n FROM catalog JOIN c USING (zone, state) GROUP BY ALL"))
def a34(s, d):
    x = stats.spread(catalog(s, d), keys=["zone", "state"], x="lon", y="lat", z="dep")
    return x.select("zone", "state", r6(F.col("rms"), "rms"), r6(F.col("depth_std"), "depth_std"), "n")


@query("a35_interval_variation", "WITH i AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts))::DOUBLE AS dt FROM events) SELECT user_id, count(*) AS n, round(stddev_pop(dt) / avg(dt), 6) AS cov FROM i WHERE dt > 0 GROUP BY 1")
def a35(s, d):
    x = stats.interval_variation(table(s, d, "events").withColumn("us", tm.micros(F.col("ts"))), keys=["user_id"], at="us")
    return x.select("user_id", "n", r6(F.col("cov"), "cov"))


@query("a36_burst", "WITH b AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS k FROM events) SELECT user_id, count(*) AS n, round(max(k) / count(*)::DOUBLE, 6) AS burst FROM b GROUP BY 1")
def a36(s, d):
    x = stats.burst_share(table(s, d, "events").withColumn("us", tm.micros(F.col("ts"))), keys=["user_id"], at="us", width=3 * tm.DAY_US)
    return x.select("user_id", "n", r6(F.col("burst"), "burst"))


@query("a37_azimuthal_gap", "WITH a AS (SELECT DISTINCT l_orderkey, (l_suppkey * 37 % 360)::DOUBLE AS az FROM lineitem), s AS (SELECT l_orderkey, coalesce(lead(az) OVER w, min(az) OVER (PARTITION BY l_orderkey) + 360) - az AS step FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY az)) SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) < 2 THEN 360.0 ELSE max(step) END AS gap FROM s GROUP BY 1")
def a37(s, d):
    az = table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 37 % 360).cast("double").alias("az")).distinct()
    return stats.azimuthal_gap(az, keys=["l_orderkey"], azimuth="az")


RADII = ", p AS (SELECT sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS r FROM stations a JOIN stations b ON a.id < b.id), k AS (SELECT power(10.0, -3 + k * 3 / 79.0::DOUBLE) AS radius FROM range(80) t(k)), c AS (SELECT radius, count(r) AS n FROM k LEFT JOIN p ON r < radius GROUP BY 1)"


@query("a38_correlation_integral", with_("stations", RADII + " SELECT round(radius, 9) AS radius, n, round(n / (SELECT count(*) FROM p), 9) AS share FROM c"))
def a38(s, d):
    return integral(s, d).select(F.round("radius", 9).alias("radius"), "n", F.round("share", 9).alias("share"))


def integral(s, d):
    return blocks.correlation_integral(stations(s, d).select("id", "lat", "lon"), id="id", coords=["lat", "lon"], radii=blocks.log_radii(0.001, 1.0, 80))


@query("a38_dimension", with_("stations", RADII + " SELECT round(regr_slope(log10(n), log10(radius)), 5) AS d2, round(regr_r2(log10(n), log10(radius)), 5) AS r2, count(*) AS radii FROM c WHERE n > 0 AND radius BETWEEN 0.03 AND 0.3"))
def a38b(s, d):
    c = integral(s, d).filter("n > 0 AND radius BETWEEN 0.03 AND 0.3")
    return c.agg(F.round(F.expr("regr_slope(log10(n), log10(radius))"), 5).alias("d2"), F.round(F.expr("regr_r2(log10(n), log10(radius))"), 5).alias("r2"), F.count("*").alias("radii"))


BOXES = ", z AS (SELECT power(2.0, -k) * 0.5 AS size FROM range(5) t(k)), b AS (SELECT size, floor((lon - (SELECT min(lon) FROM catalog)) / size) AS bx, floor((lat - (SELECT min(lat) FROM catalog)) / size) AS by_, count(*)::DOUBLE AS n FROM catalog, z GROUP BY ALL)"


@query("a39_box_counting", with_("catalog", BOXES + ", c AS (SELECT size, count(*) AS n FROM b GROUP BY 1) SELECT round(regr_slope(ln(n), ln(1 / size)), 6) AS d0 FROM c"))
def a39(s, d):
    b = stats.box_counts(catalog(s, d), coords=["lon", "lat"], sizes=[0.5 * 2.0**-k for k in range(5)])
    return b.groupBy("size").agg(F.count("*").alias("n")).agg(F.round(F.expr("regr_slope(ln(n), ln(1 / size))"), 6).alias("d0"))


@query("a40_renyi", with_("catalog", BOXES + ", p AS (SELECT size, n / sum(n) OVER (PARTITION BY size) AS p FROM b), q AS (SELECT 0 AS q UNION ALL SELECT 2 UNION ALL SELECT 3), l AS (SELECT q, size, ln(sum(power(p, q))) AS y FROM p, q GROUP BY ALL) SELECT q, round(regr_slope(y, ln(size)) / (q - 1), 6) AS dimension FROM l GROUP BY 1"))
def a40(s, d):
    b = stats.box_counts(catalog(s, d), coords=["lon", "lat"], sizes=[0.5 * 2.0**-k for k in range(5)])
    return stats.renyi_slopes(b, [0, 2, 3]).select("q", r6(F.col("dimension"), "dimension"))


@query("a41_moment_class", with_("catalog", ", g AS (SELECT *, zone || state AS family, power(10.0, 1.5 * mag + 9.1) AS mo FROM catalog), h AS (SELECT *, family || CASE WHEN idx % 7 = 0 THEN idx // 2000 ELSE 0 END AS fam FROM g), t AS (SELECT fam, arg_max(us, (mag, -idx)) AS t, sum(mo) AS m, max(mo) AS top, count(*) AS n FROM h GROUP BY 1), x AS (SELECT fam, any_value(n) AS n, round(log10(any_value(m)), 6) AS log_moment, any_value(top) / any_value(m) AS share, avg(CASE WHEN us < t THEN 1.0 ELSE 0 END) AS before, avg(CASE WHEN us > t THEN 1.0 ELSE 0 END) AS after FROM h JOIN t USING (fam) GROUP BY fam) SELECT fam, n, log_moment, round(share, 6) AS share, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN share < 0.4 THEN 'swarm' WHEN share < 0.6 THEN 'mixed' WHEN before >= 0.15 THEN 'foreshock_mainshock_aftershock' ELSE 'mainshock_aftershock' END AS kind FROM x"))
def a41(s, d):
    fam = F.concat("zone", "state", F.when(F.col("idx") % 7 == 0, F.floor(F.col("idx") / 2000)).otherwise(0).cast("string"))
    x = stats.family_class(catalog(s, d).withColumn("fam", fam), keys=["fam"], magnitude="mag", at="us", id="idx")
    return x.select("fam", "n", *(r6(F.col(c), c) for c in ("log_moment", "share", "before", "after")), "kind")


@query("a42_family_summary", with_("catalog", "SELECT zone, count(*) AS n, arg_max(idx, mag * 1e6 - idx / 1e9) AS main, (max(us) - min(us)) // 86400000000 AS days, round(max(dep) - min(dep), 6) AS depth_range FROM catalog GROUP BY 1"))
def a42(s, d):
    return catalog(s, d).groupBy("zone").agg(F.count("*").alias("n"), F.max_by("idx", F.col("mag") * 1e6 - F.col("idx") / 1e9).alias("main"), F.floor((F.max("us") - F.min("us")) / 86400000000).alias("days"), F.round(F.max("dep") - F.min("dep"), 6).alias("depth_range"))


@query("a43_plane_fit")
def a43(s, d):
    e, n = geo.local_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(128.5))
    return robust.plane_fit(catalog(s, d).select("zone", "state", e.alias("x"), n.alias("y"), F.col("dep").alias("z")), keys=["zone", "state"])


@query("a45_migration", with_("catalog", ", p AS (SELECT zone, state, us / 8.64e10 AS d, (lon - 128.5) * 111.32 * cos(radians(35.5)) AS x, (lat - 35.5) * 110.574 AS y FROM catalog), c AS (SELECT zone, state, count(*) AS n, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(x, y) AS xy FROM p GROUP BY ALL), a AS (SELECT *, atan2(xy, (xx - yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2)) AS a FROM c), s AS (SELECT p.zone, p.state, n, d, (x * cos(a) + y * sin(a)) * CASE WHEN greatest(cos(a), sin(a)) >= -least(cos(a), sin(a)) THEN 1 ELSE -1 END AS s FROM p JOIN a ON p.zone = a.zone AND p.state = a.state) SELECT zone, state, any_value(n) AS n, round(regr_slope(s, d), 7) AS rate, round(corr(s, d), 5) AS r FROM s GROUP BY zone, state"))
def a45(s, d):
    e, n = geo.local_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(128.5))
    m = robust.migration(catalog(s, d).select("zone", "state", e.alias("x"), n.alias("y"), (F.col("us") / 8.64e10).alias("days")), keys=["zone", "state"])
    return m.select("zone", "state", "n", F.round("rate", 7).alias("rate"), F.round("r", 5).alias("r"))


@query("a44_omori", with_("catalog", ", m AS (SELECT zone, arg_max(us, (mag, -idx)) AS t0 FROM catalog GROUP BY 1), l AS (SELECT zone, (us / 8.64e10) - (t0 / 8.64e10) AS t FROM catalog JOIN m USING (zone) WHERE us > t0), g AS (SELECT zone, count(*) AS n, log10(greatest(min(t), 0.001)) AS lo, (log10(max(t)) - log10(greatest(min(t), 0.001))) / 7 AS w FROM l GROUP BY 1 HAVING count(*) >= 8), b AS (SELECT zone, n, lo, w, least(floor((log10(t) - lo) / w + 1e-12), 6) AS k, count(*) AS c FROM l JOIN g USING (zone) WHERE w > 0 GROUP BY ALL), r AS (SELECT zone, n, lo + (k + 0.5) * w AS x, log10(c / (power(10.0, lo + (k + 1) * w) - power(10.0, lo + k * w))) AS y FROM b WHERE k >= 0) SELECT zone, n, CASE WHEN count(*) >= 3 THEN round(-regr_slope(y, x), 5) END AS p FROM r GROUP BY zone, n"))
def a44(s, d):
    x = stats.omori(catalog(s, d).withColumn("d", F.col("us") / 8.64e10), keys=["zone"], magnitude="mag", days="d", id="idx")
    return x.select("zone", "n", F.round("p", 5).alias("p"))


@query("a46_theil_sen", with_("readings", ", n AS (SELECT event_idx, count(*) AS n, quantile_cont(dist::DOUBLE, 0.5) AS mx, quantile_cont(ml, 0.5) AS my FROM readings GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT a.event_idx, quantile_cont((b.ml - a.ml) / (b.dist - a.dist), 0.5) AS slope FROM readings a JOIN readings b ON a.event_idx = b.event_idx AND (a.line, a.unit) < (b.line, b.unit) AND a.dist <> b.dist JOIN n ON n.event_idx = a.event_idx GROUP BY 1), k AS (SELECT event_idx, rank() OVER (PARTITION BY event_idx ORDER BY dist) + (count(*) OVER (PARTITION BY event_idx, dist) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY event_idx ORDER BY ml) + (count(*) OVER (PARTITION BY event_idx, ml) - 1) / 2.0::DOUBLE AS ry FROM readings), c AS (SELECT event_idx, corr(rx, ry) AS rho FROM k GROUP BY 1), r AS (SELECT event_idx, n, slope, rho, ml - (my - slope * mx) - slope * dist AS r FROM readings JOIN n USING (event_idx) JOIN s USING (event_idx) JOIN c USING (event_idx)) SELECT event_idx, n, round(slope, 6) AS slope, round(rho, 6) + 0.0 AS rho, round(avg(CASE WHEN abs(r) < 0.1 THEN 1.0 ELSE 0 END), 6) AS inlier, round(sqrt(avg(r * r)), 6) AS rms, avg(CASE WHEN abs(r) < 0.1 THEN 1.0 ELSE 0 END) < 0.5 AS flag FROM r GROUP BY event_idx, n, slope, rho"))
def a46(s, d):
    x = readings(s, d).withColumn("id", F.struct("line", "unit")).withColumn("x", F.col("dist").cast("double"))
    t = robust.theil_sen(x.select("event_idx", "id", "x", "ml"), keys=["event_idx"], id="id", x="x", y="ml", inlier=0.1)
    return t.select("event_idx", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("slope", "rho", "inlier", "rms")], (F.col("inlier") < 0.5).alias("flag"))


@query("a47_demeaned_slope", with_("readings", ", x AS (SELECT unit, snr - avg(snr) OVER (PARTITION BY unit) AS x, ml - avg(ml) OVER (PARTITION BY unit) AS y FROM readings) SELECT unit % 10 AS family, round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS n FROM x GROUP BY 1"))
def a47(s, d):
    w = Window.partitionBy("unit")
    x = readings(s, d).select((F.col("unit") % 10).alias("family"), (F.col("snr") - F.avg("snr").over(w)).alias("x"), (F.col("ml") - F.avg("ml").over(w)).alias("y"))
    return x.groupBy("family").agg(F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 6).alias("slope"), F.count("*").alias("n"))


@query("a47_robust_slope")
def a47b(s, d):
    r = readings(s, d).select((F.col("unit") % 10).alias("family"), F.col("unit").alias("pair"), (F.col("snr") / 50).alias("x"), (F.col("ml") + 1.7 * F.col("snr") / 50).alias("y"))
    return robust.robust_slope(r, keys=["family"], pair="pair", x="x", y="y", boots=1000)


@query("a48_linearity_gate", with_("readings", ", g AS (SELECT unit % 997 AS pair, regr_slope(ml + 1.7 * snr / 50, snr / 50) AS slope, sqrt(var_pop(ml + 1.7 * snr / 50) - covar_pop(ml + 1.7 * snr / 50, snr / 50) ** 2 / var_pop(snr / 50)) AS rms FROM readings GROUP BY 1) SELECT pair, round(slope, 6) AS slope FROM g WHERE slope BETWEEN 0.5 AND 3 AND rms < 0.388"))
def a48(s, d):
    x, y = F.col("snr") / 50, F.col("ml") + 1.7 * F.col("snr") / 50
    r = readings(s, d).select((F.col("unit") % 997).alias("pair"), x.alias("x"), y.alias("y"))
    g = r.groupBy("pair").agg(F.regr_slope("y", "x").alias("slope"), F.sqrt(F.var_pop("y") - F.pow(F.covar_pop("y", "x"), 2) / F.var_pop("x")).alias("rms"))
    return g.filter("slope BETWEEN 0.5 AND 3 AND rms < 0.388").select("pair", r6(F.col("slope"), "slope"))


@query("a49_tls_slope", with_("readings", "SELECT unit, round((var_pop(ml * 10) - var_pop(snr) + sqrt((var_pop(ml * 10) - var_pop(snr)) ** 2 + 4 * covar_pop(snr, ml * 10) ** 2)) / (2 * covar_pop(snr, ml * 10)), 5) AS slope FROM readings GROUP BY 1"))
def a49(s, d):
    return readings(s, d).withColumn("y", F.col("ml") * 10).groupBy("unit").agg(F.round(stats.total_least_squares_slope(F.col("snr"), F.col("y")), 5).alias("slope"))


@query("a50_lever_arm", "SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def a50(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("span"), F.count("*").alias("n")).filter("n >= 5").drop("n")


@query("a51_decimation_bias", with_("readings", ", o AS (SELECT year(ts) AS y, unit FROM readings GROUP BY ALL HAVING count(*) >= 60), e AS (SELECT event_idx, quantile_cont(ml, 0.5) AS full_ml FROM readings GROUP BY 1), p AS (SELECT y, event_idx, quantile_cont(ml, 0.5) AS part FROM readings JOIN o USING (unit) GROUP BY ALL) SELECT y, round(quantile_cont(part - full_ml, 0.5), 6) AS bias, count(*) AS n FROM p JOIN e USING (event_idx) GROUP BY 1"))
def a51(s, d):
    """Readings meet their unit's operating years and shuffle once, by event; the medians of each year's
    part are taken within the event's array."""
    r = readings(s, d)
    years = r.groupBy(F.year("ts").cast("long").alias("y"), "unit").agg(F.count("*").alias("n")).filter("n >= 60").groupBy("unit").agg(F.collect_list("y").alias("ys"))
    own = r.select("event_idx", "unit", "ml").join(years, "unit", "left").groupBy("event_idx").agg(F.sort_array(F.collect_list(F.struct("ml", "ys"))).alias("v"))
    middle = lambda v: F.when(F.size(v) > 0, (v[F.floor((F.size(v) - 1) / 2).cast("int")] + v[F.floor(F.size(v) / 2).cast("int")]) / 2)
    ml = lambda v: F.transform(v, lambda x: x["ml"])
    every = F.array_distinct(F.flatten(F.transform("v", lambda x: F.coalesce(x["ys"], F.array().cast("array<bigint>")))))
    part = own.select(middle(ml(F.col("v"))).alias("full_ml"), "v", F.explode(every).alias("y"))
    bias = part.select("y", (middle(ml(F.filter("v", lambda x: F.array_contains(x["ys"], F.col("y"))))) - F.col("full_ml")).alias("b"))
    return bias.groupBy("y").agg(F.round(F.percentile("b", 0.5), 6).alias("bias"), F.count("*").alias("n"))


@query("a52_operating_units", with_("readings", ", t AS (SELECT year(ts) AS y, count(DISTINCT event_idx) AS events FROM readings GROUP BY 1) SELECT y, unit, count(DISTINCT event_idx) AS n FROM readings JOIN t ON year(ts) = y GROUP BY y, unit, events HAVING count(DISTINCT event_idx) >= greatest(3, 0.01 * events)"))
def a52(s, d):
    r = readings(s, d).withColumn("y", F.year("ts").cast("long"))
    t = r.groupBy("y").agg(F.count_distinct("event_idx").alias("events"))
    return r.groupBy("y", "unit").agg(F.count_distinct("event_idx").alias("n")).join(t, "y").filter("n >= greatest(3, 0.01 * events)").select("y", "unit", "n")


@query("a53_near_reference", with_("readings", ", n AS (SELECT event_idx, quantile_cont(ml, 0.5) AS near FROM readings WHERE dist < 40 GROUP BY 1), x AS (SELECT unit, dist, ml - near AS dev FROM readings JOIN n USING (event_idx)), c AS (SELECT dist, dev - quantile_cont(dev, 0.5) OVER (PARTITION BY unit) AS dev FROM x) SELECT dist // 20 AS bin, round(quantile_cont(dev, 0.5), 6) AS bias, count(*) AS n FROM c GROUP BY 1"))
def a53(s, d):
    r = readings(s, d)
    near = r.filter("dist < 40").groupBy("event_idx").agg(F.percentile("ml", 0.5).alias("near"))
    x = r.join(near, "event_idx").withColumn("dev", F.col("ml") - F.col("near"))
    c = x.withColumn("dev", F.col("dev") - F.percentile("dev", 0.5).over(Window.partitionBy("unit")))
    return c.groupBy(F.floor(F.col("dist") / 20).alias("bin")).agg(F.round(F.percentile("dev", 0.5), 6).alias("bias"), F.count("*").alias("n"))


@query("a54_line", with_("readings", "SELECT unit, round(regr_slope(ml, snr), 6) AS slope, round(regr_intercept(ml, snr), 6) AS intercept FROM readings GROUP BY 1"))
def a54(s, d):
    return readings(s, d).groupBy("unit").agg(F.round(F.regr_slope("ml", "snr"), 6).alias("slope"), F.round(F.regr_intercept("ml", "snr"), 6).alias("intercept"))


@query("a55_funnel", with_("picks located", "SELECT 'picks' AS stage, count(*) AS n FROM picks UNION ALL SELECT 'sure', count(*) FROM picks WHERE prob >= 0.3 UNION ALL SELECT 'located', count(*) FROM located UNION ALL SELECT 'passed', count(*) FROM located WHERE erh < 5 AND erz < 5 AND gap < 270 AND num > 5 AND rms < 1"))
def a55(s, d):
    p = picks(s, d).agg(F.count("*").alias("picks"), F.count_if(F.col("prob") >= 0.3).alias("sure"))
    q = located(s, d).agg(F.count("*").alias("located"), F.count_if(F.expr("erh < 5 AND erz < 5 AND gap < 270 AND num > 5 AND rms < 1")).alias("passed"))
    un = lambda f: f.unpivot([], f.columns, "stage", "n")
    return un(p).union(un(q))


@query("a56_spread_km", with_("catalog", "SELECT zone, round(stddev_pop(lat) * 111.19, 6) AS north, round(stddev_pop(lon) * 111.19 * cos(radians(avg(lat))), 6) AS east FROM catalog GROUP BY 1"))
def a56(s, d):
    return catalog(s, d).groupBy("zone").agg(F.round(F.stddev_pop("lat") * 111.19, 6).alias("north"), F.round(F.stddev_pop("lon") * 111.19 * F.cos(F.radians(F.avg("lat"))), 6).alias("east"))


@query("a57_band_power")
def a57(s, d):
    from ..operators.signal import band_power

    return band_power(table(s, d, "embeddings"), id="vec_id", data="embedding", rate=64.0, low=1.0, high=10.0, segment=32)


@query("a58_tally", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a58(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a59_named_aggregates", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS deep, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def a59(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("deep"), F.max("l_quantity").alias("top"))


@query("a60_hellinger", with_("catalog", ", n AS (SELECT zone, year(ts) AS y, count(*) AS n FROM catalog GROUP BY ALL), c AS (SELECT zone, y, n / sum(n) OVER (PARTITION BY zone) AS p FROM n), h AS (SELECT a.zone AS x, b.zone AS y, sqrt(greatest(0, 1 - sum(sqrt(a.p * b.p)))) AS h FROM c a JOIN c b ON a.y = b.y AND a.zone < b.zone GROUP BY ALL) SELECT round(avg(h), 6) AS mean, count(*) AS pairs FROM h"))
def a60(s, d):
    c = catalog(s, d).groupBy("zone", F.year("ts").alias("y")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("zone")))
    a, b = c.select("y", F.col("zone").alias("za"), F.col("p").alias("pa")), c.select("y", F.col("zone").alias("zb"), F.col("p").alias("pb"))
    h = a.join(b, "y").filter("za < zb").groupBy("za", "zb").agg(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("pa") * F.col("pb"))))).alias("h"))
    return h.agg(F.round(F.avg("h"), 6).alias("mean"), F.count("*").alias("pairs"))


@query("a61_displacement", with_("catalog", ", b AS (SELECT idx, lat + (idx % 7) / 1000.0::DOUBLE AS lat2, lon + (idx % 5) / 1000.0::DOUBLE AS lon2, dep + (idx % 3) / 10.0::DOUBLE AS dep2 FROM catalog) SELECT zone, round(quantile_cont(sqrt(((lat2 - lat) * 111.19) ** 2 + ((lon2 - lon) * 111.19 * cos(radians(lat))) ** 2), 0.5), 5) AS horizontal, round(quantile_cont(abs(dep2 - dep), 0.5), 5) AS vertical FROM catalog JOIN b USING (idx) GROUP BY 1"))
def a61(s, d):
    a = catalog(s, d)
    b = a.select("idx", (F.col("lat") + F.col("idx") % 7 / 1000.0).alias("lat2"), (F.col("lon") + F.col("idx") % 5 / 1000.0).alias("lon2"), (F.col("dep") + F.col("idx") % 3 / 10.0).alias("dep2"))
    h = geo.flat_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "idx").groupBy("zone").agg(F.round(F.percentile(h, 0.5), 5).alias("horizontal"), F.round(F.percentile(F.abs(F.col("dep2") - F.col("dep")), 0.5), 5).alias("vertical"))


@query("a62_nearest_neighbour", with_("stations", "SELECT a.id, round(min(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2)), 9) AS apart, round(median(min(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2))) OVER (), 9) AS med FROM stations a JOIN stations b ON a.id <> b.id GROUP BY 1"))
def a62(s, d):
    from ..operators.joins import nearest_neighbour

    n = nearest_neighbour(stations(s, d).select("id", "lat", "lon"), id="id", coords=["lat", "lon"])
    return n.join(F.broadcast(n.agg(F.round(F.percentile("apart", 0.5), 9).alias("med")))).select("id", F.round("apart", 9).alias("apart"), "med")


@query("a63_profile", with_("catalog", "SELECT CASE WHEN mag < 4 THEN 'small' WHEN mag < 5 THEN 'middle' ELSE 'large' END AS bin, count(*) AS n, round(avg(dep), 6) AS depth FROM catalog GROUP BY 1"))
def a63(s, d):
    b = F.when(F.col("mag") < 4, "small").when(F.col("mag") < 5, "middle").otherwise("large")
    return catalog(s, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("dep"), 6).alias("depth"))


@query("a65_stage_status", "SELECT year(o_orderdate)::INTEGER AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a65(s, d):
    return table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("m1_size_distribution", with_("readings", ", e AS (SELECT event_idx, quantile_cont(ml, 0.5) AS magnitude FROM (SELECT * REPLACE (CASE WHEN dist <= 60 THEN ml END AS ml) FROM readings WHERE snr >= 2) GROUP BY 1 HAVING count(ml) >= 3), c AS (SELECT round_even(magnitude * 10, 0)::INTEGER AS m10, count(*) AS n FROM e GROUP BY 1) SELECT m10, n, sum(n) OVER (ORDER BY m10 DESC)::BIGINT AS n_cum FROM c"))
def m1(s, d):
    from .magnitudes import event_magnitudes

    return stats.size_distribution(event_magnitudes(readings(s, d), cap=60, least=3).filter("status = 'ok'"), magnitude="magnitude")


@query("m2_mc_and_b", with_("readings", f", e AS (SELECT event_idx, quantile_cont(ml, 0.5) AS m FROM (SELECT * REPLACE (CASE WHEN dist <= 60 THEN ml END AS ml) FROM readings WHERE snr >= 2) GROUP BY 1 HAVING count(ml) >= 3), c AS (SELECT round_even(m * 10, 0)::INTEGER AS m10, count(*) AS n FROM e GROUP BY 1), k AS (SELECT round(m10 / 10.0::DOUBLE + 0.2, 6) AS mc FROM c ORDER BY n DESC, m10 LIMIT 1) SELECT mc, round(1 / ({LN10} * (avg(m) - mc + 0.05)), 6) AS b, count(*) AS n FROM e, k WHERE m >= mc GROUP BY 1"))
def m2(s, d):
    from .magnitudes import event_magnitudes, mc_and_b

    return mc_and_b(event_magnitudes(readings(s, d), cap=60, least=3).filter("status = 'ok'"), magnitude="magnitude")


@query("c04_families", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), v AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), f(id, family) USING KEY (id) AS (SELECT DISTINCT a, a FROM v UNION SELECT v.b, min(f.family) FROM f JOIN v ON v.a = f.id JOIN recurring.f AS r ON r.id = v.b GROUP BY v.b, r.family HAVING min(f.family) < r.family) SELECT id, family FROM f")
def c04(s, d):
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    nodes = e.select(F.col("a").alias("id")).union(e.select("b"))
    return graph.connected(e, nodes, a="a", b="b", id="id")


@query("c07_tree_depth", "WITH RECURSIVE t AS (SELECT o_custkey AS id, CASE WHEN o_custkey > 0 THEN o_custkey // 3 END AS parent FROM (SELECT DISTINCT o_custkey FROM orders) UNION SELECT 0, NULL), u AS (SELECT id, CASE WHEN parent IN (SELECT id FROM t) THEN parent END AS parent FROM t), r AS (SELECT id, id AS root, 0::BIGINT AS depth FROM u WHERE parent IS NULL UNION ALL SELECT u.id, root, depth + 1 FROM u JOIN r ON u.parent = r.id) SELECT DISTINCT id, root, depth FROM r")
def c07(s, d):
    t = table(s, d, "orders").select(F.col("o_custkey").alias("id")).union(s.range(1)).distinct()
    t = t.withColumn("p", F.when(F.col("id") > 0, F.floor(F.col("id") / 3)))
    u = t.join(t.select(F.col("id").alias("known")), F.col("p") == F.col("known"), "left").select("id", F.col("known").alias("parent"))
    return graph.depths(u, id="id", parent="parent").withColumn("depth", F.col("depth").cast("long"))


ALL = ", n AS (SELECT idx, us / 8.64e10 AS t, lon * 100 AS x, lat * 100 AS y, mag AS m FROM catalog), pr AS MATERIALIZED (SELECT c.idx, o.idx AS parent, (log10(c.t - o.t) - 0.5 * o.m) + (1.6 * log10(greatest(sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2), 0.01)) - 0.5 * o.m) AS e FROM n c JOIN n o ON o.t < c.t), par AS MATERIALIZED (SELECT idx, arg_min(parent, e) AS parent, min(e) AS log_eta FROM pr GROUP BY 1)".replace("pr AS MATERIALIZED", "pr AS NOT MATERIALIZED")


@query("j23_nearest_parent", with_("catalog", ALL + " SELECT idx, parent, round(log_eta, 5) AS log_eta FROM par"))
def j23(s, d):
    n = catalog(s, d).select("idx", (F.col("us") / 8.64e10).alias("t"), (F.col("lon") * 100).alias("x"), (F.col("lat") * 100).alias("y"), F.col("mag").alias("m"))
    return graph.nearest_parent(n, id="idx", t="t", x="x", y="y", m="m").select("idx", "parent", F.round("log_eta", 5).alias("log_eta"))


@query("c09_dbscan", with_("stations", ", p AS (SELECT a.id AS a, b.id AS b, sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS r FROM stations a JOIN stations b ON sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) <= 0.09), core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) >= 4), r AS (SELECT id, id AS reach FROM core UNION SELECT r.id, p.b FROM r JOIN p ON r.reach = p.a JOIN core ON core.id = p.b), f AS (SELECT id, min(reach) AS cluster FROM r GROUP BY 1), n AS (SELECT a AS id, arg_min(b, r * 1e6 + b / 1e6) AS core FROM p JOIN core ON core.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1) SELECT s.id, coalesce(f.cluster, g.cluster) AS cluster FROM stations s LEFT JOIN f ON f.id = s.id LEFT JOIN n ON n.id = s.id LEFT JOIN f g ON g.id = n.core").replace("WITH stations", "WITH RECURSIVE stations"))
def c09(s, d):
    return graph.density_clusters(stations(s, d).select("id", "lat", "lon"), id="id", coords=["lat", "lon"], reach=0.09, least=4)


UNITS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, len(embedding) AS w, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)"


def shifted(lags: int, a: str = "a", b: str = "b") -> list[tuple[int, str]]:
    """SQL of the normalised correlation at each shift of the first against the second."""
    return [(k, f"list_inner_product({a}.v[{1 + max(k, 0)}:{a}.w + {min(k, 0)}], {b}.v[{1 + max(-k, 0)}:{b}.w - {max(k, 0)}]) / ({a}.norm * {b}.norm)") for k in sorted(range(-lags, lags + 1), key=lambda k: (abs(k), k))]


@query("c12_similarity", f"WITH {UNITS}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, [{', '.join(x for _, x in shifted(3))}] AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(list_max(c), 5) AS cc, [{', '.join(str(k) for k, _ in shifted(3))}][list_position(c, list_max(c))]::BIGINT AS lag, round(c[1], 5) AS cc0 FROM c WHERE list_max(c) >= 0.3")
def c12(s, d):
    p = blocks.similar(table(s, d, "embeddings"), id="vec_id", data="embedding", keys=["label"], lags=3, least=0.3)
    return p.select("a", "b", F.round("cc", 5).alias("cc"), "lag", F.round("cc0", 5).alias("cc0"))


@query("c13_anti_pairs", f"WITH v AS (SELECT vec_id, label, part, (embedding::DOUBLE[])[1 + part * 21:21 + part * 21] AS v, 21 AS w FROM embeddings, range(3) t(part)), u AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM v), c AS (SELECT a.vec_id AS a, b.vec_id AS b, a.part, [{', '.join(x for _, x in shifted(2))}] AS c FROM u a JOIN u b ON a.label = b.label AND a.part = b.part AND a.vec_id < b.vec_id) SELECT a, b, round(max(c[1]), 5) AS worst, round(max(list_max(c)), 5) AS cc_pos FROM c GROUP BY a, b HAVING count(*) = 3 AND max(c[1]) <= -0.05 AND max(list_max(c)) < 0.5")
def c13(s, d):
    """Three parts of a vector stand for its components: all must be reversed, none alike at any shift."""
    parts = table(s, d, "embeddings").select("vec_id", "label", *(F.slice("embedding", 1 + k * 21, 21).alias(f"part{k}") for k in range(3)))
    found = blocks.reversed_in_all(parts, id="vec_id", data=["part0", "part1", "part2"], keys=["label"], lags=2, most=-0.05, below=0.5)
    return found.select("a", "b", F.round("worst", 5).alias("worst"), F.round("cc_pos", 5).alias("cc_pos"))


@query("c14_network_confirmation", with_("readings", ", s AS (SELECT event_idx % 50 AS family, unit % 20 AS station, avg(ml) AS cc FROM readings GROUP BY ALL) SELECT family, count(*) AS n_available, count(*) FILTER (cc >= 4.5) AS n_confirmed, round(quantile_cont(cc, 0.5), 6) AS med, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN count(*) FILTER (cc >= 4.5) >= 3 THEN 'confirmed' ELSE 'rejected' END AS status FROM s GROUP BY 1"))
def c14(s, d):
    x = readings(s, d).groupBy((F.col("event_idx") % 50).alias("family"), (F.col("unit") % 20).alias("station")).agg(F.avg("ml").alias("cc"))
    n, k = F.count("*"), F.count_if(F.col("cc") >= 4.5)
    return x.groupBy("family").agg(n.alias("n_available"), k.alias("n_confirmed"), F.round(F.percentile("cc", 0.5), 6).alias("med"), F.when(n < 3, "insufficient").when(k >= 3, "confirmed").otherwise("rejected").alias("status"))


@query("w20_change_points")
def w20(s, d):
    x = readings(s, d).withColumn("us", tm.micros(F.col("ts")))
    return robust.change_points(x, keys=["unit"], at="us", value="ml", least=300, step=0.08, tests=300, level=0.01)


@query("c01_kmeans")
def c01(s, d):
    from ..operators.clusters import kmeans

    return kmeans(catalog(s, d).select("idx", "lon", "lat"), id="idx", features=["lon", "lat"], k=7, starts=10)


@query("c02_cluster_indices", with_("catalog", ", c AS (SELECT idx, state AS cluster, lon, lat FROM catalog), m AS (SELECT avg(lon) AS x, avg(lat) AS y, count(*)::DOUBLE AS n FROM c), k AS (SELECT cluster, avg(lon) AS cx, avg(lat) AS cy, count(*) AS cn FROM c GROUP BY 1), b AS (SELECT sum(cn * ((cx - x) ** 2 + (cy - y) ** 2)) AS between_, count(*) AS kk FROM k, m), w AS (SELECT sum((lon - cx) ** 2 + (lat - cy) ** 2) AS within FROM c JOIN k USING (cluster)) SELECT round((between_ / (kk - 1)) / (within / (n - kk)), 5) AS calinski_harabasz FROM b, w, m"))
def c02(s, d):
    from ..operators.clusters import calinski_harabasz

    return calinski_harabasz(catalog(s, d).select(F.col("state").alias("cluster"), "lon", "lat"), cluster="cluster", features=["lon", "lat"]).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query("c03_two_modes")
def c03(s, d):
    from ..operators.clusters import valley

    return valley(readings(s, d).select(F.col("ml").alias("x")), value="x")


@query("k04_station_card", with_("stations", "SELECT id, rpad(sta, 5, ' ') || ' ' || rpad(net::VARCHAR, 2, ' ') || '  HHZ  ' || printf('%2d %7.4f', floor(lat)::INTEGER, (lat - floor(lat)) * 60) || 'N' || printf('%3d %7.4f', floor(lon)::INTEGER, (lon - floor(lon)) * 60) || 'E' || printf('%4d', elev::INTEGER) AS card FROM stations"))
def k04(s, d):
    return stations(s, d).select("id", text.station_card(F.col("net").cast("string"), F.col("sta"), F.col("lat"), F.col("lon"), F.col("elev")).alias("card"))


@query("k05_phase_blocks", "SELECT l_orderkey AS event_idx, count(*) AS n, string_agg(rpad('S' || l_suppkey, 5, ' ') || 'HHZ IP' || (l_linenumber % 4) || ' ' || strftime(l_shipdate, '%y%m%d%H%M%S') || '.00', chr(10) ORDER BY l_shipdate, 'S' || l_suppkey, l_linenumber % 4) AS block FROM lineitem GROUP BY 1")
def k05(s, d):
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("event_idx"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station"), F.lit("P").alias("phase"), (F.col("l_linenumber") % 4).alias("weight"), F.col("l_shipdate").alias("time"))
    return records.phase_lines(p)


@query("k07_subset_blocks", "SELECT l_orderkey AS id, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def k07(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    return records.subset_blocks(lines, table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("k08_renumber", "SELECT s_suppkey AS id, 'row ' || lpad((s_suppkey + 7)::VARCHAR, 6, ' ') || ' end' AS value FROM supplier WHERE s_acctbal > 0")
def k08(s, d):
    lines = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("row "), F.lpad(F.col("s_suppkey").cast("string"), 6, " "), F.lit(" end")).alias("value"))
    ids = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 7).alias("new_id"))
    return records.renumber_blocks(lines, ids, at=5, width=6).select("id", "value")


@query("s06_year_or_before", "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders WHERE year(o_orderdate) <= 2010)")
def s06(s, d):
    return tables.of_year_or_before(table(s, d, "orders").withColumn("year", F.year("o_orderdate")), 2010).agg(F.count("*").alias("n"))


@query("s07_clamped_year", "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = greatest((SELECT min(year(o_orderdate)) FROM orders), least(1980, (SELECT max(year(o_orderdate)) FROM orders)))")
def s07(s, d):
    return tables.of_clamped_year(table(s, d, "orders").withColumn("year", F.year("o_orderdate")), 1980).agg(F.count("*").alias("n"))


@query("s12_fixed_width", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice, 2) END AS price FROM orders")
def s12(s, d):
    o = table(s, d, "orders")
    value = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, " "), F.when(F.col("o_orderkey") % 11 == 0, "************").otherwise(F.format_string("%12.2f", "o_totalprice")))
    return records.fixed(o.select(value.alias("value")), [("id", 1, 10, "long"), ("price", 11, 12, "double")])


@query("s13_blocks", "SELECT l_orderkey AS id, count(*) AS n_phases, max(l_discount) AS top, round(sqrt(avg(l_discount * l_discount)), 6) AS rms FROM lineitem GROUP BY 1")
def s13(s, d):
    li = table(s, d, "lineitem")
    head = li.select(F.col("l_orderkey").alias("k")).distinct().select(F.lit("f").alias("path"), (F.col("k") * 1000).alias("n"), F.concat(F.lit("H "), F.col("k").cast("string")).alias("value"))
    body = li.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))).select(F.lit("f").alias("path"), (F.col("l_orderkey") * 1000 + F.col("r")).alias("n"), F.concat(F.lit("P "), F.col("l_discount").cast("string")).alias("value"))
    lines = head.union(body).withColumn("path", F.floor(F.col("n") / 100000).cast("string"))
    b = records.blocks(lines, number="n", value="value", starts=F.col("value").startswith("H "))
    x = F.when(F.col("value").startswith("P "), F.substring("value", 3, 20).cast("double"))
    return b.groupBy("path", "block").agg(F.max(F.when(F.col("value").startswith("H "), F.substring("value", 3, 20).cast("long"))).alias("id"), F.count(x).alias("n_phases"), F.max(x).alias("top"), F.round(F.sqrt(F.avg(x * x)), 6).alias("rms")).select("id", "n_phases", "top", "rms")


@query("s15_split_columns", "SELECT s_suppkey::DOUBLE AS a, s_acctbal AS b, s_nationkey::DOUBLE AS c FROM supplier WHERE s_acctbal > 0")
def s15(s, d):
    x = table(s, d, "supplier")
    lines = x.select(F.when(F.col("s_acctbal") > 0, F.format_string("  %d   %.2f %d ", "s_suppkey", "s_acctbal", "s_nationkey")).otherwise(F.col("s_suppkey").cast("string")).alias("value"))
    return records.read_columns(lines, ["a", "b", "c"])


@query("s19_pruned_read", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s19(s, d):
    return table(s, d, "events").select("event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s20_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s20(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("s21_first_source_wins", "SELECT k, arg_min(v, p) AS v FROM (SELECT s_suppkey AS k, s_name AS v, 1 AS p FROM supplier UNION ALL SELECT c_custkey, c_name, 2 FROM customer) GROUP BY 1")
def s21(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.lit(1).alias("p"))
    b = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(2).alias("p"))
    return a.union(b).groupBy("k").agg(F.min_by("v", "p").alias("v"))


@query("x01_station_text", with_("picks", "SELECT pick_id, split_part(station, '.', 1) AS net, split_part(station, '.', 2) AS code, station || '.' AS dotted FROM picks"))
def x01(s, d):
    st = F.col("station")
    return picks(s, d).select("pick_id", text.network(st).alias("net"), text.code(st).alias("code"), text.with_dot(st).alias("dotted"))


@query("x02_base_code", with_("epochs", "SELECT 'N' || lpad((user_id % 1000)::VARCHAR, 3, '0') || 'a' AS code, 'N' || lpad((user_id % 1000)::VARCHAR, 3, '0') AS base FROM epochs"))
def x02(s, d):
    c = F.concat(F.lit("N"), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"), F.lit("a"))
    return epochs(s, d).select(c.alias("code"), text.base_code(c).alias("base"))


@query("x03_times", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS key, lpad(dayofyear(ts)::VARCHAR, 3, '0') AS doy, round(year(ts) + (dayofyear(ts) - 1) / 365.25::DOUBLE, 6) AS y1, round(year(ts) + (epoch_us(ts) - epoch_us(make_date(year(ts), 1, 1)::TIMESTAMP)) / (epoch_us(make_date(year(ts) + 1, 1, 1)::TIMESTAMP) - epoch_us(make_date(year(ts), 1, 1)::TIMESTAMP))::DOUBLE, 6) AS y2, strftime(ts + INTERVAL 9 HOURS, '%d%H') AS kst, round((epoch_us(ts) % 86400000000) / 3.6e9, 6) AS hour, dayofweek(ts) IN (0, 6) AS weekend FROM events")
def x03(s, d):
    t = F.col("ts")
    return table(s, d, "events").select("event_id", tm.event_id(t).alias("key"), tm.day_of_year_text(t).alias("doy"), r6(tm.year_by_days(t), "y1"), r6(tm.decimal_year(t), "y2"), F.date_format(tm.korean(t), "ddHH").alias("kst"), r6(tm.hour_of_day(t), "hour"), tm.is_weekend(t).alias("weekend"))


@query("x04_magnitude_laws", "SELECT l_orderkey, l_linenumber, round(log10(l_quantity) + 1.450676 * log10((1 + l_partkey % 120) / 17.0::DOUBLE) - 0.000661 * (1 + l_partkey % 120 - 17) + 2.0, 6) AS regional, round(log10(l_quantity) + 0.5107 * log10((1 + l_partkey % 120) / 100.0::DOUBLE) + 0.001699 * (1 + l_partkey % 120 - 100) + 3.0, 6) AS national FROM lineitem")
def x04(s, d):
    r = 1 + F.col("l_partkey") % 120
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", r6(geo.local_magnitude(F.col("l_quantity"), r), "regional"), r6(geo.local_magnitude(F.col("l_quantity"), r, "national"), "national"))


@query("x05_travel_times", with_("catalog", "SELECT idx, round(sqrt(dep * dep + 400) / (CASE WHEN dep >= 15 THEN 6.38 ELSE 5.98 END), 6) AS p, round(sqrt(dep * dep + 400) / (CASE WHEN dep >= 20.7 THEN 3.7 WHEN dep >= 7.29 THEN 3.6 ELSE 3.4 END), 6) AS s FROM catalog"))
def x05(s, d):
    return catalog(s, d).select("idx", r6(geo.slant_seconds(F.lit(20.0), F.col("dep"), F.lit("P")), "p"), r6(geo.slant_seconds(F.lit(20.0), F.col("dep"), F.lit("S"), "four_layer"), "s"))


@query("x06_head_waves", with_("readings", "SELECT DISTINCT dist, round(least(dist / 5.63, CASE WHEN dist >= 2 * 7.29 * (5.63 / 6.17) / sqrt(1 - (5.63 / 6.17) ** 2) THEN dist / 6.17 + 2 * 7.29 * sqrt(1 - (5.63 / 6.17) ** 2) / 5.63 END, CASE WHEN dist >= 2 * 7.29 * (5.63 / 6.58) / sqrt(1 - (5.63 / 6.58) ** 2) + 2 * (20.7 - 7.29) * (6.17 / 6.58) / sqrt(1 - (6.17 / 6.58) ** 2) THEN dist / 6.58 + 2 * 7.29 * sqrt(1 - (5.63 / 6.58) ** 2) / 5.63 + 2 * (20.7 - 7.29) * sqrt(1 - (6.17 / 6.58) ** 2) / 6.17 END, CASE WHEN dist >= 2 * 7.29 * (5.63 / 7.77) / sqrt(1 - (5.63 / 7.77) ** 2) + 2 * (20.7 - 7.29) * (6.17 / 7.77) / sqrt(1 - (6.17 / 7.77) ** 2) + 2 * (31.3 - 20.7) * (6.58 / 7.77) / sqrt(1 - (6.58 / 7.77) ** 2) THEN dist / 7.77 + 2 * 7.29 * sqrt(1 - (5.63 / 7.77) ** 2) / 5.63 + 2 * (20.7 - 7.29) * sqrt(1 - (6.17 / 7.77) ** 2) / 6.17 + 2 * (31.3 - 20.7) * sqrt(1 - (6.58 / 7.77) ** 2) / 6.58 END), 6) AS seconds FROM readings"))
def x06(s, d):
    return readings(s, d).select("dist").distinct().select("dist", r6(geo.first_arrival_seconds(F.col("dist").cast("double"), 1), "seconds"))


@query("x07_array_kernels", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_transform(v, lambda x: x - list_avg(v)) AS c FROM e) SELECT vec_id, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS norm, round(list_sum(c[2:]) , 6) AS tail FROM m")
def x07(s, d):
    from ..operators.signal import demeaned, norm

    c = demeaned(F.col("embedding").cast("array<double>"))
    total = F.aggregate(F.slice("c", 2, 1_000_000), F.lit(0.0), lambda a, x: a + x)
    return table(s, d, "embeddings").withColumn("c", c).select("vec_id", r6(norm(F.col("c")), "norm"), r6(total, "tail"))


@query("x08_map_default", "SELECT o_orderkey, coalesce(CASE year(o_orderdate) WHEN 1996 THEN 0.1 WHEN 1998 THEN -0.2 END, 0.0)::DOUBLE AS bias FROM orders")
def x08(s, d):
    m = F.create_map(F.lit(1996), F.lit(0.1), F.lit(1998), F.lit(-0.2))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(m, F.year("o_orderdate")), F.lit(0.0)).alias("bias"))
