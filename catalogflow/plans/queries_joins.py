"""Filters (F), joins (J), windows (W), sorts (T) and sets (U) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..functions import time as tm
from ..operators import blocks, overlap
from ..operators import joins as jn
from ..operators import windows as wn
from .registry import catalog, epochs, located, origins, picks, query, r6, readings, stations, table, with_

HAV = "2 * 6371.0 * asin(sqrt(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2)))"


def hav(lat1, lon1, lat2, lon2):
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query("f01_qc_gate", with_("located", "SELECT idx FROM located WHERE erh < 5 AND erz < 5 AND gap < 270 AND num > 5 AND rms < 1"))
def f01(s, d):
    return located(s, d).filter("erh < 5 AND erz < 5 AND gap < 270 AND num > 5 AND rms < 1").select("idx")


@query("f03_box", with_("catalog", "SELECT idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM catalog WHERE lat BETWEEN 35.2 AND 35.8 AND lon BETWEEN 128.3 AND 128.7"))
def f03(s, d):
    return catalog(s, d).filter(F.col("lat").between(35.2, 35.8) & F.col("lon").between(128.3, 128.7)).select("idx", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"))


@query("f04_radius", with_("catalog", f"SELECT idx, round({hav('lat', 'lon', '35.5', '128.5')}, 6) AS km FROM catalog WHERE {hav('lat', 'lon', '35.5', '128.5')} <= 30"))
def f04(s, d):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(128.5))
    return catalog(s, d).withColumn("k", km).filter("k <= 30").select("idx", r6(F.col("k"), "km"))


@query("f05_probability_floor", with_("picks", "SELECT pick_id FROM picks WHERE prob >= 0.3"))
def f05(s, d):
    return picks(s, d).filter("prob >= 0.3").select("pick_id")


@query("f06_epoch_overlap", with_("epochs", "SELECT value FROM epochs WHERE t0 <= epoch_us(TIMESTAMP '2024-01-20') AND t1 >= epoch_us(TIMESTAMP '2024-01-13')"))
def f06(s, d):
    return epochs(s, d).filter((F.col("t0") <= 1705708800000000) & (F.col("t1") >= 1705104000000000)).select("value")


@query("f07_first_band", "SELECT p_partkey, CASE WHEN list_contains(b, 'HH') THEN 'HH' WHEN list_contains(b, 'EL') THEN 'EL' WHEN list_contains(b, 'HG') THEN 'HG' END AS band FROM (SELECT p_partkey, string_split(CASE p_size % 4 WHEN 0 THEN 'HG/HH' WHEN 1 THEN 'EL/HG' WHEN 2 THEN 'HG' ELSE 'BH' END, '/') AS b FROM part)")
def f07(s, d):
    bands = F.element_at(F.array(*map(F.lit, ("HG/HH", "EL/HG", "HG", "BH"))), F.col("p_size") % 4 + 1)
    return table(s, d, "part").select("p_partkey", text.first_band(bands).alias("band"))


@query("f08_reconcile_columns", "SELECT s_suppkey AS idx, s_acctbal AS latitude FROM supplier")
def f08(s, d):
    from ..sources.tables import reconciled

    return reconciled(table(s, d, "supplier").select(F.col("s_suppkey").alias("event_idx"), F.col("s_acctbal").alias("lat")), {"event_idx": "idx"}).select("idx", "latitude")


@query("f09_snr_gate", with_("readings", "SELECT event_idx, line FROM readings WHERE snr >= 2 AND ml IS NOT NULL"))
def f09(s, d):
    return readings(s, d).filter("snr >= 2 AND ml IS NOT NULL").select("event_idx", "line")


@query("f10_dead_floor", with_("readings", "SELECT event_idx, line FROM readings WHERE NOT peak < 5000"))
def f10(s, d):
    return readings(s, d).filter("NOT peak < 5000").select("event_idx", "line")


@query("f11_distance_cap", with_("readings", "SELECT event_idx, line, round(CASE WHEN dist <= 60 THEN ml END, 6) AS ml FROM readings"))
def f11(s, d):
    return readings(s, d).select("event_idx", "line", r6(F.when(F.col("dist") <= 60, F.col("ml")), "ml"))


@query("f12_selection_policy", with_("catalog", "SELECT idx FROM catalog WHERE state = 'F' OR mag >= 5"))
def f12(s, d):
    return catalog(s, d).filter("state = 'F' OR mag >= 5").select("idx")


@query("f13_clip", with_("readings", "SELECT event_idx, line, least(greatest(snr, 5.0), 40.0) AS snr FROM readings"))
def f13(s, d):
    return readings(s, d).select("event_idx", "line", F.least(F.greatest("snr", F.lit(5.0)), F.lit(40.0)).alias("snr"))


@query("f14_suspect", with_("located", "SELECT idx, (erh > 3 OR num < 10 OR gap = 0) AS suspect FROM located"))
def f14(s, d):
    return located(s, d).selectExpr("idx", "erh > 3 OR num < 10 OR gap = 0 AS suspect")


@query("f15_cube_or_member", with_("catalog", "SELECT idx FROM catalog WHERE (lat BETWEEN 35.4 AND 35.6 AND lon BETWEEN 128.4 AND 128.6 AND dep BETWEEN 5 AND 15) OR idx IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)"))
def f15(s, d):
    member = table(s, d, "lineitem").filter("l_suppkey = 7").select(F.col("l_orderkey").alias("idx")).distinct().withColumn("m", F.lit(True))
    cube = "lat BETWEEN 35.4 AND 35.6 AND lon BETWEEN 128.4 AND 128.6 AND dep BETWEEN 5 AND 15"
    return catalog(s, d).join(member, "idx", "left").filter(f"({cube}) OR m").select("idx")


@query("f16_roles", with_("catalog", "SELECT idx, CASE WHEN state = 'F' THEN 'member' WHEN mag IS NULL THEN 'not_in_pop' WHEN state = 'O' THEN 'background' ELSE 'other_family' END AS role FROM catalog"))
def f16(s, d):
    return catalog(s, d).selectExpr("idx", "CASE WHEN state = 'F' THEN 'member' WHEN mag IS NULL THEN 'not_in_pop' WHEN state = 'O' THEN 'background' ELSE 'other_family' END AS role")


@query("f17_weight_code", with_("picks", "SELECT pick_id, least(CASE WHEN prob IS NULL THEN 3 ELSE CASE WHEN prob >= 0.8 THEN 0 WHEN prob >= 0.6 THEN 1 WHEN prob >= 0.4 THEN 2 ELSE 3 END + CASE WHEN phase = 'view' THEN 1 ELSE 0 END END, 3) AS weight FROM picks"))
def f17(s, d):
    return picks(s, d).select("pick_id", text.weight_code(F.col("prob"), F.when(F.col("phase") == "view", "S").otherwise("P")).alias("weight"))


@query("f18_local_km", with_("catalog", "SELECT idx, round((lon - 128.5) * 111.32 * cos(radians(35.5)), 6) AS east, round((lat - 35.5) * 110.574, 6) AS north FROM catalog"))
def f18(s, d):
    e, n = geo.local_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(128.5))
    return catalog(s, d).select("idx", r6(e, "east"), r6(n, "north"))


@query("f19_mask", with_("catalog", "SELECT idx FROM catalog WHERE idx NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def f19(s, d):
    return catalog(s, d).join(table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx")), "idx", "left_anti").select("idx")


SEC = 1_000_000
CANDIDATES = f"""
, known AS (SELECT user_id, 35 + (user_id * 37 % 100) / 100.0::DOUBLE AS slat, 128 + (user_id * 53 % 100) / 100.0::DOUBLE AS slon FROM (SELECT DISTINCT user_id FROM events)),
orphan AS (SELECT pick_id, station, phase, us AS pus, prob, slat, slon FROM picks JOIN known ON station = 'KG.U' || user_id WHERE phase IN ('view', 'click') AND prob >= 0.02),
taken AS (SELECT DISTINCT idx, station, phase FROM origins JOIN picks p ON abs(p.us - origins.us) <= 60 * {SEC} WHERE phase = 'view'),
tt AS (SELECT o.idx, p.*, {hav("lat", "lon", "slat", "slon")} AS epi, o.us, dep FROM origins o JOIN orphan p ON pus BETWEEN o.us - 5 * {SEC} AND o.us + 600 * {SEC}),
cand AS (SELECT idx, pick_id, station, phase, (pus - us) / 1e6 - 10 * sqrt(epi * epi + dep * dep) / (CASE WHEN phase = 'click' THEN CASE WHEN dep >= 15 THEN 6.38 ELSE 5.98 END ELSE CASE WHEN dep >= 15 THEN 3.79 ELSE 3.4 END END) AS residual, epi
         FROM tt WHERE epi <= 100 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.idx = tt.idx AND t.station = tt.station AND t.phase = tt.phase)),
fit AS (SELECT * FROM cand WHERE abs(residual) <= 60)
"""


def candidates(s, d, best=False):
    """Picks that fit an event's predicted arrival and are not among its assigned ones; the ``best`` of an event's
    station and phase alone, if asked."""
    from .augment import candidates as find

    p = picks(s, d)
    user = table(s, d, "events").select("user_id").distinct()
    sta = user.select(F.concat(F.lit("KG.U"), F.col("user_id").cast("string")).alias("station"), (35 + F.col("user_id") * 37 % 100 / 100.0).alias("slat"), (128 + F.col("user_id") * 53 % 100 / 100.0).alias("slon"))
    orphans = p.filter("phase IN ('view', 'click')").select("pick_id", "station", F.when(F.col("phase") == "view", "S").otherwise("P").alias("kind"), "phase", F.col("us").alias("pus"), "prob")
    # a view's event lies up to 600 s before it and 5 s after; the station's views within 60 s of that event are its assigned ones
    around = Window.partitionBy("station", "phase").orderBy("pus").rangeBetween(-660 * SEC, 65 * SEC)
    orphans = orphans.withColumn("views", F.collect_list(F.when(F.col("phase") == "view", F.col("pus"))).over(around))
    taken = F.exists("views", lambda t: F.abs(t - F.col("us")) <= 60 * SEC)
    kind = {"least": 0.02, "radius": 100.0, "tolerance": 60.0, "before": 5 * SEC, "after": 600 * SEC, "stretch": 10.0, "unless": taken}
    if not best:
        return find(origins(s, d), None, sta, orphans, **kind)
    near = Window.partitionBy("station", "phase").orderBy("pus").rangeBetween(-120 * SEC, 120 * SEC)
    sound = orphans.filter("prob >= 0.02").dropDuplicates(["pick_id", "station", "phase", "pus"]).withColumn("rivals", F.collect_list(F.struct("pus", "pick_id")).over(near))
    sound = sound.withColumn("rivals", F.filter("rivals", lambda r: (r.pus != F.col("pus")) | ~r.pick_id.eqNullSafe(F.col("pick_id"))))
    o = origins(s, d).withColumn("n", F.count("*").over(Window.partitionBy("idx")))
    once = find(o.filter("n = 1"), None, sta, sound, rivals="rivals", **kind)
    again = o.filter("n > 1")
    if again.isEmpty():
        return once
    return once.unionByName(wn.first_by(find(again, None, sta, orphans, **kind), ["idx", "station", "phase"], [F.abs("residual"), F.col("pick_id")]))


@query("j01_orphan_picks", with_("picks origins", CANDIDATES + "SELECT idx, pick_id, round(residual, 4) AS residual, round(epi, 4) AS epi FROM fit"))
def j01(s, d):
    return candidates(s, d).select("idx", "pick_id", F.round("residual", 4).alias("residual"), F.round("epi", 4).alias("epi"))


@query("w04_best_match", with_("picks origins", CANDIDATES + ", r AS (SELECT *, row_number() OVER w AS k, lead(abs(residual)) OVER w - abs(residual) AS gap FROM fit WINDOW w AS (PARTITION BY pick_id ORDER BY abs(residual), idx)) SELECT pick_id, idx FROM r WHERE k = 1 AND (gap IS NULL OR gap >= 0.2)"))
def w04(s, d):
    return wn.resolve_ambiguous(candidates(s, d), pick=["pick_id"], residual="residual", event="idx", tie=0.2)[0].select("pick_id", "idx")


@query("w04_decisions", with_("picks origins", CANDIDATES + ", r AS (SELECT *, row_number() OVER w AS k, lead(idx) OVER w AS runner_event, lead(abs(residual)) OVER w - abs(residual) AS gap FROM fit WINDOW w AS (PARTITION BY pick_id ORDER BY abs(residual), idx)) SELECT pick_id, idx AS best_event, runner_event, CASE WHEN gap < 0.2 THEN 'dropped_ambiguous' ELSE 'best_match_wins' END AS decision FROM r WHERE k = 1 AND gap IS NOT NULL"))
def w04b(s, d):
    return wn.resolve_ambiguous(candidates(s, d), pick=["pick_id"], residual="residual", event="idx", tie=0.2)[1].select("pick_id", "best_event", "runner_event", "decision")


@query("w05_one_pick_a_station", with_("picks origins", CANDIDATES + "SELECT idx, station, phase, pick_id FROM fit QUALIFY row_number() OVER (PARTITION BY idx, station, phase ORDER BY abs(residual), pick_id) = 1"))
def w05(s, d):
    return candidates(s, d, best=True).select("idx", "station", "phase", "pick_id")


@query("j02_not_assigned", with_("picks", "SELECT pick_id FROM picks p WHERE NOT EXISTS (SELECT 1 FROM picks q WHERE q.phase = 'signup' AND q.station = p.station AND q.ts::DATE = p.ts::DATE)"))
def j02(s, d):
    p = picks(s, d).withColumn("day", F.to_date("ts"))
    return p.join(p.filter("phase = 'signup'").select("station", "day"), ["station", "day"], "left_anti").select("pick_id")


VIEWS = "(SELECT pick_id, station, us AS vus FROM picks WHERE phase = 'view')"


@query("j03_nearest", with_("picks origins", f"SELECT idx, pick_id, vus - us AS dt FROM origins JOIN {VIEWS} ON abs(vus - us) <= 300 * {SEC} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY abs(vus - us), vus, pick_id) = 1"))
def j03(s, d):
    v = picks(s, d).filter("phase = 'view'").select("pick_id", F.col("us").alias("vus"))
    return jn.nearest(origins(s, d).select("idx", "us"), v, at="us", time="vus", tolerance=300 * SEC, left_id="idx", right_id="pick_id").select("idx", "pick_id", "dt")


@query("j04_asof_left", with_("picks origins", f"SELECT o.idx, n.pick_id FROM origins o LEFT JOIN (SELECT idx, pick_id FROM origins JOIN {VIEWS} ON abs(vus - us) <= 30 * {SEC} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY abs(vus - us), vus, pick_id) = 1) n USING (idx)"))
def j04(s, d):
    v = picks(s, d).filter("phase = 'view'").select("pick_id", F.col("us").alias("vus"))
    return jn.nearest_left(origins(s, d).select("idx", "us"), v, at="us", time="vus", tolerance=30 * SEC, left_id="idx", right_id="pick_id").select("idx", "pick_id")


@query("j05_located_within", with_("picks origins", f"SELECT idx FROM origins WHERE EXISTS (SELECT 1 FROM {VIEWS} WHERE abs(vus - us) <= 120 * {SEC})"))
def j05(s, d):
    v = picks(s, d).filter("phase = 'view'").select(F.col("us").alias("vus"))
    return jn.has_within(origins(s, d), v, at="us", time="vus", tolerance=120 * SEC, left_id="idx").select("idx")


@query("j07_id_chain", "SELECT l_orderkey, l_linenumber, first_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT o_orderdate AS od, min(o_orderkey) AS first_key FROM orders GROUP BY 1) ON od = o_orderdate")
def j07(s, d):
    o = table(s, d, "orders")
    first = o.groupBy("o_orderdate").agg(F.min("o_orderkey").alias("first_key"))
    return table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(first, "o_orderdate").select("l_orderkey", "l_linenumber", "first_key")


@query("j08_left_then_dedup", "SELECT o_orderkey, max(l_extendedprice) AS price FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j08(s, d):
    j = table(s, d, "orders").select("o_orderkey").join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return wn.first_by(j, ["o_orderkey"], [F.desc_nulls_last("price"), F.col("l_linenumber")]).select("o_orderkey", "price")


@query("j09_left_chain", "SELECT s_suppkey, n_name, r_name, p_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = s_suppkey * 3")
def j09(s, d):
    t = lambda n: table(s, d, n)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("part"), F.col("p_partkey") == F.col("s_suppkey") * 3, "left").select("s_suppkey", "n_name", "r_name", "p_name")


@query("j10_suffixes", "SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey AS unit_a, b.l_suppkey AS unit_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = 'A' AND b.l_returnflag = 'A'")
def j10(s, d):
    x = table(s, d, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("unit"))
    keys = ["l_orderkey", "l_linenumber"]
    return jn.tagged(x, "_a", keys).join(jn.tagged(x, "_b", keys), keys)


@query("j11_exact_time", with_("catalog", "SELECT a.idx AS idx_a, b.idx AS idx_b FROM catalog a JOIN catalog b ON a.us = b.us AND a.state = 'F' AND b.state = 'P' AND a.zone = b.zone"))
def j11(s, d):
    c = catalog(s, d)
    return jn.tagged(c.filter("state = 'F'"), "_a", ["us", "zone"]).join(jn.tagged(c.filter("state = 'P'"), "_b", ["us", "zone"]), ["us", "zone"]).select("idx_a", "idx_b")


@query("j12_rounded_second", with_("picks origins", "SELECT pick_id FROM picks WHERE phase <> 'purchase' AND round_even(us / 6e7, 0) IN (SELECT round_even(us / 6e7, 0) FROM origins)"))
def j12(s, d):
    key = lambda f: f.withColumn("k", F.bround(F.col("us") / 6e7))
    return key(picks(s, d).filter("phase <> 'purchase'")).join(key(origins(s, d)).select("k"), "k", "left_semi").select("pick_id")


@query("j13_time_and_place", with_("picks origins", f"SELECT idx, pick_id FROM origins o JOIN (SELECT pick_id, us // (600 * {SEC}) AS k, (pick_id % 997) / 997.0::DOUBLE + 128 AS plon FROM picks WHERE phase = 'click') p ON o.us // (600 * {SEC}) = k QUALIFY row_number() OVER (PARTITION BY idx ORDER BY abs(plon - lon), pick_id) = 1"))
def j13(s, d):
    k = F.floor(F.col("us") / (600 * SEC)).alias("k")
    p = picks(s, d).filter("phase = 'click'").select("pick_id", k, (F.col("pick_id") % 997 / 997.0 + 128).alias("plon"))
    j = jn.beside(origins(s, d).select("idx", "lon", k), p, at="lon", time="plon", right_id="pick_id", keys=["k"])
    return wn.first_by(j, ["idx"], [F.abs(F.col("plon") - F.col("lon")), F.col("pick_id")]).select("idx", "pick_id")


@query("j14_keyed_nearest", with_("picks", f"SELECT a.pick_id, b.pick_id AS mate FROM picks a JOIN picks b ON a.station = b.station AND a.phase = 'view' AND b.phase = 'click' AND abs(a.us - b.us) <= 3600000000 QUALIFY row_number() OVER (PARTITION BY a.pick_id ORDER BY abs(a.us - b.us), b.us, b.pick_id) = 1"))
def j14(s, d):
    p = picks(s, d)
    b = p.filter("phase = 'click'").select("station", F.col("pick_id").alias("mate"), F.col("us").alias("bus"))
    return jn.nearest(p.filter("phase = 'view'").select("pick_id", "station", "us"), b, at="us", time="bus", tolerance=3600 * SEC, left_id="pick_id", right_id="mate", keys=["station"]).select("pick_id", "mate")


@query("j15_epoch_lookup", with_("picks epochs", "SELECT pick_id, coalesce(value, substr(station, 4)) AS code FROM picks LEFT JOIN epochs ON substr(station, 4) = base AND us >= t0 AND us < t1"))
def j15(s, d):
    p = picks(s, d).withColumn("base", text.code(F.col("station")))
    e = epochs(s, d).select("base", "value", "t0", "t1")
    return jn.in_epoch(p, e, key="base", at="us", start="t0", end="t1", value="value", fallback="base").select("pick_id", F.col("value").alias("code"))


@query("j16_fallbacks", "SELECT p_partkey, coalesce(s_name, c_name, 'none') AS found FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey")
def j16(s, d):
    first = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("found"))
    second = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("found"))
    return jn.first_match(table(s, d, "part").select(F.col("p_partkey").alias("k")), [first, second], key="k", value="found").select(F.col("k").alias("p_partkey"), F.coalesce("found", F.lit("none")).alias("found"))


@query("j17_alias", "SELECT p_partkey, coalesce(a.k, b.k) AS resolved FROM part LEFT JOIN (SELECT DISTINCT s_suppkey::VARCHAR AS k FROM supplier WHERE s_acctbal > 0) a ON p_partkey::VARCHAR = a.k LEFT JOIN (SELECT DISTINCT s_suppkey::VARCHAR AS k FROM supplier WHERE s_acctbal > 0) b ON p_partkey || '2' = b.k")
def j17(s, d):
    known = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("code"))
    return jn.aliased(table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("code")), known).select("p_partkey", "resolved")


@query("j18_coverage", "SELECT n_nationkey, count(s_suppkey) AS n, count(c_custkey) AS m FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j18(s, d):
    t = lambda n: table(s, d, n)
    a = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    b = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("b"))
    both = t("nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").fillna(0, ["a", "b"])
    many = F.greatest(F.col("a"), F.lit(1)) * F.greatest(F.col("b"), F.lit(1))
    return both.select("n_nationkey", F.when(F.col("a") > 0, many).otherwise(0).alias("n"), F.when(F.col("b") > 0, many).otherwise(0).alias("m"))


@query("j19_epoch_families", with_("epochs", ", k AS (SELECT user_id % 7 AS site, value, t0, t1, lag(t1) OVER (PARTITION BY user_id % 7 ORDER BY t0, value) AS before FROM epochs) SELECT site, count(*) AS n, bool_and(before IS NULL OR t0 >= before - 86400000000) AS family FROM k GROUP BY 1"))
def j19(s, d):
    w = Window.partitionBy("site").orderBy("t0", "value")
    k = epochs(s, d).withColumn("site", F.col("user_id") % 7).withColumn("before", F.lag("t1").over(w))
    return k.groupBy("site").agg(F.count("*").alias("n"), F.bool_and(F.col("before").isNull() | (F.col("t0") >= F.col("before") - tm.DAY_US)).alias("family"))


@query("j20_near_duplicates", with_("origins", f", s AS (SELECT idx, list_distinct(list(p.event_type || p.user_id)) AS picks FROM origins o JOIN events p ON abs(epoch_us(p.ts) - o.us) <= 600 * {SEC} GROUP BY 1), p AS (SELECT a.idx AS idx_a, b.idx AS idx_b FROM origins a JOIN origins b ON (a.us < b.us OR (a.us = b.us AND a.idx < b.idx)) AND b.us - a.us <= 1800 * {SEC} AND abs(a.lat - b.lat) <= 0.5 AND abs(a.lon - b.lon) <= 0.5) SELECT idx_a, idx_b, round(len(list_intersect(x.picks, y.picks)) / greatest(len(list_distinct(list_concat(x.picks, y.picks))), 1)::DOUBLE, 6) AS jaccard FROM p JOIN s x ON x.idx = idx_a JOIN s y ON y.idx = idx_b"))
def j20(s, d):
    o = origins(s, d).select("idx", "us", "lat", "lon")
    e = table(s, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), tm.micros(F.col("ts")).alias("pus"))
    pairs = overlap.alike(o, e, window=600 * SEC, within=1800 * SEC, reach=0.5)
    return pairs.select("idx_a", "idx_b", r6(F.col("shared") / F.greatest("either", F.lit(1)), "jaccard"))


@query("j21_pair_differences", "SELECT a.l_suppkey AS unit, a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, round(a.l_quantity - b.l_quantity, 6) AS dq FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber")
def j21(s, d):
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    keys = ["unit", "l_orderkey"]
    return jn.tagged(x, "_a", keys).join(jn.tagged(x, "_b", keys), keys).filter("k_a < k_b").select("unit", "l_orderkey", F.col("k_a").alias("i"), F.col("k_b").alias("j"), r6(F.col("q_a") - F.col("q_b"), "dq"))


@query("j22_pairs_within", with_("stations", "SELECT a.id AS id_a, b.id AS id_b, round(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2), 6) AS apart FROM stations a JOIN stations b ON a.id < b.id AND sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) <= 0.125"))
def j22(s, d):
    return jn.place_pairs(stations(s, d).select("id", "lat", "lon"), id="id", coords=["lat", "lon"], reach=0.125).select("id_a", "id_b", r6(F.col("apart"), "apart"))


@query("j24_nearest_station", with_("origins stations", f"SELECT idx, round(min({hav('o.lat', 'o.lon', 's.lat', 's.lon')}), 6) AS km FROM origins o, stations s GROUP BY 1"))
def j24(s, d):
    from .augment import nearest_stations

    near = nearest_stations(origins(s, d).select("idx", "lat", "lon"), stations(s, d).select("id", F.col("lat").alias("slat"), F.col("lon").alias("slon")), n=1)
    return near.select("idx", r6(F.col("km"), "km"))


@query("j26_stations_in_radius", with_("stations", f"SELECT id, round({hav('lat', 'lon', '35.5', '128.5')}, 6) AS km FROM stations WHERE {hav('lat', 'lon', '35.5', '128.5')} <= 40"))
def j26(s, d):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(128.5))
    return stations(s, d).withColumn("k", km).filter("k <= 40").select("id", r6(F.col("k"), "km"))


@query("j27_truth_recall", with_("picks origins", f"SELECT o.idx, EXISTS (SELECT 1 FROM picks p WHERE p.phase = 'error' AND abs(p.us - o.us) <= 300 * {SEC} AND {hav('o.lat', 'o.lon', '35 + (p.pick_id * 7 % 991) / 991.0::DOUBLE', '128 + (p.pick_id % 997) / 997.0::DOUBLE')} <= 30) AS found FROM origins o"))
def j27(s, d):
    o = origins(s, d)
    e = picks(s, d).filter("phase = 'error'").select(F.col("us").alias("pus"), (35 + F.col("pick_id") * 7 % 991 / 991.0).alias("plat"), (128 + F.col("pick_id") % 997 / 997.0).alias("plon"))
    near = jn.range_join(o.select("idx", "us", "lat", "lon"), e, at="us", time="pus", before=300 * SEC, after=300 * SEC)
    hit = near.filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= 30).select("idx").distinct().withColumn("found", F.lit(True))
    return o.select("idx").join(hit, "idx", "left").select("idx", F.coalesce("found", F.lit(False)).alias("found"))


@query("j28_by_key_not_position", "SELECT c_custkey AS idx, c_name AS name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j28(s, d):
    """Two relations in different orders, one with members missing, meet by key."""
    members = table(s, d, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "idx")
    return table(s, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name")).join(members, "idx", "left")


@query("j29_component_support", "SELECT user_id, count(DISTINCT event_type) AS n, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS support FROM events WHERE event_type IN ('view', 'click', 'error') AND value > 100 GROUP BY 1")
def j29(s, d):
    e = table(s, d, "events").filter("event_type IN ('view', 'click', 'error') AND value > 100")
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n"), F.concat_ws("+", F.array_sort(F.collect_set("event_type"))).alias("support"))


@query("w01_same_second_ids", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE WHEN k = 0 THEN '' ELSE chr((97 + k)::INTEGER) END AS event_key FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS k FROM orders)")
def w01(s, d):
    k = F.row_number().over(Window.partitionBy("o_orderdate", "o_orderpriority", "o_orderstatus").orderBy("o_orderkey")) - 1
    o = table(s, d, "orders").withColumn("k", k)
    return o.select("o_orderkey", F.concat(tm.event_id(F.col("o_orderdate")), F.when(F.col("k") == 0, "").otherwise(text.character(97 + F.col("k")))).alias("event_key"))


@query("w02_epoch_codes", with_("epochs", "SELECT base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN chr((96 + row_number() OVER w)::INTEGER) ELSE '' END AS epoch_code, t0, coalesce(lead(t0) OVER w, t1) AS t1 FROM epochs WINDOW w AS (PARTITION BY base ORDER BY t0)"))
def w02(s, d):
    return wn.with_epochs(epochs(s, d).select("base", "t0", F.col("t1").alias("e")), key="base", start="t0", end="e").select("epoch_code", "t0", "t1")


@query("w03_earliest_pick", with_("picks", "SELECT station, phase, pick_id FROM picks QUALIFY row_number() OVER (PARTITION BY station, phase ORDER BY us, pick_id) = 1"))
def w03(s, d):
    return picks(s, d).groupBy("station", "phase").agg(F.min(F.struct("us", "pick_id")).alias("m")).select("station", "phase", "m.pick_id")


ROLL = "(PARTITION BY unit ORDER BY epoch_us(ts) RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


@query("w06_rolling_median", with_("readings", ", x AS (SELECT *, epoch_us(ts) AS us FROM readings) SELECT event_idx, line, round(CASE WHEN count(ml) OVER w >= 20 THEN quantile_cont(ml, 0.5) OVER w END, 6) AS med FROM x WINDOW w AS (PARTITION BY unit ORDER BY us RANGE BETWEEN 15551999999999 PRECEDING AND CURRENT ROW)"))
def w06(s, d):
    x = readings(s, d).withColumn("us", tm.micros(F.col("ts")))
    return wn.rolling_percentiles(x, keys=["unit"], at="us", value="ml", width=180 * tm.DAY_US, shares=[0.5], least=20, names=["m"]).select("event_idx", "line", r6(F.col("m"), "med"))


@query("w07_rolling_envelope", with_("readings", ", x AS (SELECT *, epoch_us(ts) AS us FROM readings) SELECT event_idx, line, round(CASE WHEN count(ml) OVER w >= 25 THEN quantile_cont(ml, 0.05) OVER w END, 6) AS p05, round(CASE WHEN count(ml) OVER w >= 25 THEN quantile_cont(ml, 0.1) OVER w END, 6) AS p10 FROM x WINDOW w AS (PARTITION BY unit ORDER BY us RANGE BETWEEN 31535999999999 PRECEDING AND CURRENT ROW)"))
def w07(s, d):
    x = readings(s, d).withColumn("us", tm.micros(F.col("ts")))
    return wn.rolling_percentiles(x, keys=["unit"], at="us", value="ml", width=365 * tm.DAY_US, shares=[0.05, 0.1], least=25, names=["a", "b"]).select("event_idx", "line", r6(F.col("a"), "p05"), r6(F.col("b"), "p10"))


@query("w08_centred_median", with_("readings", "SELECT event_idx, line, round(CASE WHEN count(ml) OVER w >= 2 THEN quantile_cont(ml, 0.5) OVER w END, 6) AS med FROM readings WINDOW w AS (PARTITION BY unit ORDER BY ts, event_idx, line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def w08(s, d):
    return wn.centred_median(readings(s, d), keys=["unit"], order=["ts", "event_idx", "line"], value="ml", before=1, after=1, least=2, name="m").select("event_idx", "line", r6(F.col("m"), "med"))


DY = "(year(ts) + (epoch_us(ts) - epoch_us(make_date(year(ts), 1, 1)::TIMESTAMP)) / (epoch_us(make_date(year(ts) + 1, 1, 1)::TIMESTAMP) - epoch_us(make_date(year(ts), 1, 1)::TIMESTAMP))::DOUBLE)"


@query("w09_moving_windows", with_("catalog", f", c AS (SELECT round({DY}, 6) AS y, mag FROM catalog), g AS (SELECT round(1996 + k * 0.5::DOUBLE, 6) AS centre FROM range(11) r(k)) SELECT centre, count(*) AS n, round(avg(mag), 6) AS mean FROM c JOIN g ON y >= centre - 1 AND y < centre + 1 GROUP BY 1 HAVING count(*) >= 50"))
def w09(s, d):
    c = catalog(s, d).withColumn("y", F.round(tm.decimal_year(F.col("ts")), 6))
    return wn.hopping(c, at="y", first=1996.0, last=2001.0, step=0.5, half=1.0).groupBy("centre").agg(F.count("*").alias("n"), F.round(F.avg("mag"), 6).alias("mean")).filter("n >= 50")


@query("w10_moving_density", with_("catalog", f", c AS (SELECT round({DY}, 6) AS y, floor(lon / 0.1)::BIGINT AS gx, floor(lat / 0.1)::BIGINT AS gy FROM catalog), g AS (SELECT round(1996 + k * 0.25::DOUBLE, 6) AS centre FROM range(21) r(k)) SELECT centre, gx, gy, count(*) AS n FROM c JOIN g ON y >= centre - 1 AND y < centre + 1 GROUP BY ALL"))
def w10(s, d):
    c = catalog(s, d).select(F.round(tm.decimal_year(F.col("ts")), 6).alias("y"), F.floor(F.col("lon") / 0.1).alias("gx"), F.floor(F.col("lat") / 0.1).alias("gy"))
    return wn.hopping(c, at="y", first=1996.0, last=2001.0, step=0.25, half=1.0).groupBy("centre", "gx", "gy").agg(F.count("*").alias("n"))


@query("w11_cumulative", with_("catalog", "SELECT idx, zone, count(*) OVER w AS n, round(sum(power(10.0, 1.5 * mag + 9.1)) OVER w / sum(power(10.0, 1.5 * mag + 9.1)) OVER (PARTITION BY zone), 6) AS share FROM catalog WINDOW w AS (PARTITION BY zone ORDER BY us, idx ROWS UNBOUNDED PRECEDING)"))
def w11(s, d):
    c = catalog(s, d).select("idx", "zone", "us", geo.moment_nm(F.col("mag")).alias("moment"))
    r = wn.carried(c, keys=["zone"], at="us", id="idx", width=30 * tm.DAY_US, sums={"n": F.lit(1).cast("long"), "m": F.col("moment")})
    return r.select("idx", "zone", "n", r6(F.col("m") / F.col("m_all"), "share"))


@query("w13_interval", with_("catalog", "SELECT idx, us - lag(us) OVER (PARTITION BY zone ORDER BY us, idx) AS dt FROM catalog"))
def w13(s, d):
    p = wn.previous(catalog(s, d).select("idx", "zone", "us"), keys=["zone"], at="us", id="idx", width=30 * tm.DAY_US, value="us", name="before")
    return p.select("idx", (F.col("us") - F.col("before")).alias("dt"))


@query("w14_relabel_by_size", "SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS label FROM events GROUP BY 1")
def w14(s, d):
    n = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).alias("label"))


@query("w15_largest_step", with_("readings", ", x AS (SELECT unit, event_idx, line, ml - lag(ml) OVER (PARTITION BY unit ORDER BY ts, event_idx, line) AS step FROM readings) SELECT unit, round(step, 6) AS step FROM x WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY abs(step) DESC, event_idx, line) = 1"))
def w15(s, d):
    x = readings(s, d).withColumn("step", F.col("ml") - F.lag("ml").over(Window.partitionBy("unit").orderBy("ts", "event_idx", "line"))).filter("step IS NOT NULL")
    return wn.first_by(x, ["unit"], [F.desc(F.abs("step")), F.col("event_idx"), F.col("line")]).select("unit", r6(F.col("step"), "step"))


BREAKS = ", b AS (SELECT s_suppkey AS unit, [DATE '1996-06-01' + (s_suppkey % 90)::INTEGER, DATE '1999-01-01' + (s_suppkey % 50)::INTEGER] AS breaks FROM supplier WHERE s_acctbal > 0)"


def with_breaks(s, d):
    x = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("unit"), F.array(F.date_add(F.lit("1996-06-01").cast("date"), (F.col("s_suppkey") % 90).cast("int")), F.date_add(F.lit("1999-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int"))).alias("breaks"))
    r = readings(s, d).join(x, "unit", "left")
    return r.withColumn("epoch", wn.epoch_ordinal(F.col("breaks"), F.to_date("ts"))).withColumn("own", text.epoch_unit(F.col("unit").cast("string"), F.col("epoch")))


@query("w16_epoch_ordinal", with_("readings", BREAKS + " SELECT event_idx, line, unit || '@e' || coalesce(len(list_filter(breaks, lambda x: x <= ts::DATE)), 0) AS own FROM readings LEFT JOIN b USING (unit)"))
def w16(s, d):
    return with_breaks(s, d).select("event_idx", "line", "own")


@query("w17_merge_small", with_("readings", BREAKS + ", e AS (SELECT event_idx, line, unit, unit || '@e' || coalesce(len(list_filter(breaks, lambda x: x <= ts::DATE)), 0) AS own FROM readings LEFT JOIN b USING (unit)) SELECT event_idx, line, CASE WHEN count(*) OVER (PARTITION BY own) >= 150 OR own = '1@e0' THEN own ELSE unit::VARCHAR END AS unit_merged FROM e"))
def w17(s, d):
    x = with_breaks(s, d).withColumn("parent", F.col("unit").cast("string"))
    return wn.merge_small(x, unit="own", parent="parent", least=150, protect="1@e0").select("event_idx", "line", "unit_merged")


@query("w18_islands", "WITH d AS (SELECT DISTINCT user_id, ts::DATE - DATE '1970-01-01' AS day FROM events), f AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM f) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, run")
def w18(s, d):
    days = table(s, d, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    return wn.islands(days, keys=["user_id"], day="day")


@query("w19_global_ids", "WITH l AS (SELECT event_id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS k FROM events), t AS (SELECT day, max(k) + 1 AS top FROM l GROUP BY 1), o AS (SELECT day, coalesce(sum(top) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t) SELECT event_id, start + k AS global_id FROM l JOIN o USING (day)")
def w19(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("k", (F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1).cast("long"))
    return wn.global_index(e.select("event_id", "day", "k"), group="day", local="k").select("event_id", "global_id")


@query("w21_anomaly_onset", with_("readings", ", m AS (SELECT unit, date_trunc('month', ts)::DATE AS month, quantile_cont(ml, 0.5) AS med FROM readings GROUP BY ALL) SELECT unit, strftime(min(month), '%Y-%m-%d') AS onset FROM m WHERE med < 4.3 AND month < DATE '2001-01-01' GROUP BY 1"))
def w21(s, d):
    m = readings(s, d).groupBy("unit", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.percentile("ml", 0.5).alias("med"))
    return m.filter("med < 4.3 AND month < DATE '2001-01-01'").groupBy("unit").agg(F.min("month").cast("string").alias("onset"))


@query("w22_shape_change", with_("readings", ", x AS (SELECT *, CASE WHEN line % 3 <> 0 THEN line % 2 END AS shape FROM readings), p AS (SELECT *, last_value(shape IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts, event_idx, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM x) SELECT event_idx, line FROM p WHERE shape <> previous"))
def w22(s, d):
    x = readings(s, d).withColumn("shape", F.when(F.col("line") % 3 != 0, F.col("line") % 2)).withColumn("o", F.struct("ts", "event_idx", "line"))
    return wn.changes(x, keys=["unit"], at="o", value="shape").filter("shape <> previous").select("event_idx", "line")


KERNEL = {"mu": 0.1, "k": 0.5, "alpha_ln10": 1.0, "c": 0.01, "p": 1.1, "reference": 5.0}


@query("w24_intensity", with_("catalog", ", d AS (SELECT us / 8.64e10 AS t, sum(0.5 * power(10.0, mag - 5)) AS w FROM catalog GROUP BY 1) SELECT a.t, round(0.1 + coalesce(sum(b.w * power(a.t - b.t + 0.01, -1.1)), 0), 6) AS rate FROM d a LEFT JOIN d b ON b.t < a.t GROUP BY 1"))
def w24(s, d):
    events = catalog(s, d).select((F.col("us") / 8.64e10).alias("t"), "mag")
    return blocks.excitation(events, t="t", m="mag", **KERNEL).select("t", r6(F.col("rate"), "rate"))


@query("w24_compensator", with_("catalog", ", e AS (SELECT us / 8.64e10 AS t, mag, max(us / 8.64e10) OVER () AS t1, min(us / 8.64e10) OVER () AS t0 FROM catalog) SELECT count(*) AS n, round(0.1 * any_value(t1 - t0) + sum(0.5 * power(10.0, mag - 5) * (power(0.01, -0.1) - power(t1 - t + 0.01, -0.1)) / 0.1), 4) AS expected FROM e"))
def w24b(s, d):
    events = catalog(s, d).select((F.col("us") / 8.64e10).alias("t"), "mag")
    return blocks.compensator(events, t="t", m="mag", **KERNEL).select("n", F.round("expected", 4).alias("expected"))


@query("w25_gain_change", with_("readings", ", g AS (SELECT unit, year(ts) AS y, quantile_cont(ml, 0.5) AS g FROM readings GROUP BY ALL), x AS (SELECT *, lag(g) OVER (PARTITION BY unit ORDER BY y) AS p FROM g) SELECT unit, y FROM x WHERE abs(g - p) > 0.05"))
def w25(s, d):
    g = readings(s, d).groupBy("unit", F.year("ts").cast("long").alias("y")).agg(F.percentile("ml", 0.5).alias("g"))
    return g.withColumn("p", F.lag("g").over(Window.partitionBy("unit").orderBy("y"))).filter("abs(g - p) > 0.05").select("unit", "y")


@query("t01_stable_sort", "SELECT l_orderkey AS event_idx, l_linenumber AS line FROM lineitem ORDER BY l_orderkey, l_shipdate, l_linenumber")
def t01(s, d):
    return table(s, d, "lineitem").orderBy("l_orderkey", "l_shipdate", "l_linenumber").select(F.col("l_orderkey").alias("event_idx"), F.col("l_linenumber").alias("line"))


@query("t02_top_n", with_("catalog", "SELECT idx, round(mag, 6) AS mag FROM catalog ORDER BY catalog.mag DESC, idx LIMIT 25"))
def t02(s, d):
    return catalog(s, d).orderBy(F.desc("mag"), "idx").limit(25).select("idx", r6(F.col("mag"), "mag"))


@query("t04_top_families", "SELECT user_id, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8")
def t04(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top")).orderBy(F.desc("n"), "user_id").limit(8)


@query("t05_nearest_n", with_("origins stations", f"SELECT idx, id FROM origins o, stations s WHERE bal > 0 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY {hav('o.lat', 'o.lon', 's.lat', 's.lon')}, id) <= 3"))
def t05(s, d):
    from .augment import nearest_stations

    known = stations(s, d).filter("bal > 0").select("id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return nearest_stations(origins(s, d).select("idx", "lat", "lon"), known, n=3).select("idx", "id")


@query("t06_seeded_sample", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY sha256('s7:' || event_id), event_id LIMIT 200)")
def t06(s, d):
    return table(s, d, "events").orderBy(F.sha2(F.concat(F.lit("s7:"), F.col("event_id").cast("string")), 256), "event_id").limit(200).orderBy("ts").select("event_id")


@query("t08_by_size_of_step", "SELECT n_nationkey, k FROM (SELECT n_nationkey, row_number() OVER (ORDER BY abs(n_nationkey - 12.3)) AS k FROM nation)")
def t08(s, d):
    return table(s, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.abs(F.col("n_nationkey") - 12.3))).alias("k"))


@query("t09_nearest_value", with_("catalog", "SELECT idx FROM catalog WHERE state = 'F' AND dep < 10 ORDER BY abs(mag - 5.0), idx LIMIT 1"))
def t09(s, d):
    return catalog(s, d).filter("state = 'F' AND dep < 10").orderBy(F.abs(F.col("mag") - 5.0), "idx").limit(1).select("idx")


@query("u01_union_by_name", "SELECT 'a' AS origin, l_orderkey AS k, l_tax AS x, NULL::VARCHAR AS y FROM lineitem UNION ALL SELECT 'b', o_orderkey, NULL, o_orderstatus FROM orders")
def u01(s, d):
    a = table(s, d, "lineitem").select(F.lit("a").alias("origin"), F.col("l_orderkey").alias("k"), F.col("l_tax").alias("x"))
    b = table(s, d, "orders").select(F.lit("b").alias("origin"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("y"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_keep_first", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_suppkey) = 1")
def u02(s, d):
    return wn.first_by(table(s, d, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_shipdate"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber")


@query("u03_set_algebra", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' AND value > 60 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 60) UNION ALL SELECT 'either', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' AND value > 60 UNION SELECT user_id FROM events WHERE event_type = 'click' AND value > 60) UNION ALL SELECT 'first', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' AND value > 60 EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value > 60)")
def u03(s, d):
    e = table(s, d, "events").filter("value > 60")
    a, b = e.filter("event_type = 'view'").select("user_id"), e.filter("event_type = 'click'").select("user_id")
    n = lambda k, f: f.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n("both", a.intersect(b)).union(n("either", a.union(b).distinct())).union(n("first", a.subtract(b)))


@query("u04_missing_days", "SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT user_id, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM events) EXCEPT SELECT user_id, ts::DATE FROM events)")
def u04(s, d):
    e = table(s, d, "events")
    every = e.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)")).alias("day"))
    return every.subtract(e.select("user_id", F.to_date("ts").alias("day"))).select("user_id", F.col("day").cast("string").alias("day"))


@query("u05_common_ids", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u05(s, d):
    x = table(s, d, "lineitem")
    own = lambda f: x.filter(F.col("l_returnflag") == f).select("l_orderkey")
    return own("A").intersect(own("N")).intersect(own("R"))


@query("u07_union_dedup", "SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE day(ts) <= 10 UNION ALL SELECT user_id FROM events WHERE day(ts) > 20)")
def u07(s, d):
    e = table(s, d, "events")
    return e.filter("day(ts) <= 10").select("user_id").union(e.filter("day(ts) > 20").select("user_id")).dropDuplicates(["user_id"])


@query("u08_threshold_rekey", "SELECT o_custkey AS unit, l_linenumber, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount BETWEEN 0.04 AND 0.06")
def u08(s, d):
    return table(s, d, "lineitem").filter("l_discount BETWEEN 0.04 AND 0.06").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("unit"), "l_linenumber", "l_tax")
