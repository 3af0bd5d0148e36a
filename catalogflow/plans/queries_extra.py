"""Waveforms, geodesy, array kernels, cluster indices, hooks, functions of the SQL surface and ids on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo, udf
from ..functions import time as tm
from ..operators import blocks, cluster_tree, clusters, detect, excite, signal
from ..operators import joins as jn
from ..sources import records, seed, tables, waveforms
from ..streaming import windows as sw
from .queries_joins import hav
from .queries_more import streamed
from .registry import catalog, origins, query, r6, stations, table, with_

FLAT = "sqrt(((slat - lat) * 111.19) ** 2 + ((slon - lon) * 111.19 * cos(radians(lat))) ** 2)"


@query("j25_nearest_node", with_("origins stations", f"SELECT idx, arg_min(s.elev, ({hav('o.lat', 'o.lon', 's.lat', 's.lon')}, s.id)) AS value FROM origins o, stations s GROUP BY 1"))
def j25(s, d):
    """The value at the nearest node of an irregular grid (here the stations)."""
    from .augment import nearest_stations

    nodes = stations(s, d).select("id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.col("elev").alias("value"))
    return nearest_stations(origins(s, d).select("idx", "lat", "lon"), nodes, n=1).select("idx", "value")


@query("s11_coverage", "SELECT 'U' || user_id AS sta, 'HH' AS band, count(DISTINCT dayofyear(ts)) AS days, count(DISTINCT dayofyear(ts)) / 10.0::DOUBLE AS coverage FROM events WHERE year(ts) = 2024 AND dayofyear(ts) BETWEEN 6 AND 15 GROUP BY 1")
def s11(s, d):
    sta = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    files = table(s, d, "events").select(F.concat(F.lit("/data/"), sta, F.lit("/HHZ.D/KG."), sta, F.lit(".HHZ.D."), F.year("ts").cast("string"), F.lit("."), tm.day_of_year_text(F.col("ts"))).alias("path"))
    return tables.coverage(files, year=2024, first=6, last=15)


@query("s14_covariances", "SELECT s_suppkey AS id, round(s_acctbal / 100, 3) AS c11, CASE WHEN s_suppkey % 7 <> 0 THEN round(-s_acctbal / 1000, 3) END AS c12, round(s_nationkey + 0.5, 3)::DOUBLE AS c22 FROM supplier")
def s14(s, d):
    x = table(s, d, "supplier")
    cell = lambda c: F.format_string("%8.3f", c)
    k = F.col("s_suppkey")
    second = F.when(k % 7 != 0, cell(-F.col("s_acctbal") / 1000)).otherwise("********")
    lines = F.array(F.concat(F.lit("EVENT "), k.cast("string")), F.lit("COVARIANCE (KM)"), F.concat(cell(F.col("s_acctbal") / 100), second), F.concat(F.lit("   0.000"), cell(F.col("s_nationkey") + 0.5)))
    text = x.select(k.cast("string").alias("path"), F.posexplode(lines).alias("n", "value"))
    c = records.read_covariances(text, rows=2)
    return c.select(F.col("path").cast("long").alias("id"), "c11", "c12", "c22")


@query("k06_headers", with_("catalog stations", ", a AS (SELECT l_orderkey AS idx, l_suppkey AS id, min(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 10 END) AS p, min(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity / 10 END) AS s FROM lineitem GROUP BY ALL), j AS (SELECT a.idx, 'S' || a.id AS station, c.lat, c.lon, dep, t.lat AS slat, t.lon AS slon, p, s FROM a JOIN catalog c USING (idx) JOIN stations t ON t.id = a.id) SELECT idx, station, round(" + FLAT + ", 5) AS km, round(coalesce(p, sqrt((" + FLAT + ") ** 2 + dep * dep) / (CASE WHEN dep >= 15 THEN 6.38 ELSE 5.98 END)), 5) AS p_seconds, p IS NOT NULL AS p_picked, round(coalesce(s, sqrt((" + FLAT + ") ** 2 + dep * dep) / (CASE WHEN dep >= 15 THEN 3.79 ELSE 3.4 END)), 5) AS s_seconds FROM j"))
def k06(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("idx"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station"), F.when(F.col("l_linenumber") % 2 == 0, "P").otherwise("S").alias("phase"), (F.col("l_quantity") * 100_000).cast("long").alias("late"))
    li = jn.spread(li, "idx")
    c = catalog(s, d).select("idx", "us", "lat", "lon", "dep")
    arrivals = li.join(c.select("idx", "us"), "idx").withColumn("pus", F.col("us") + F.col("late"))
    sta = stations(s, d).select(F.col("sta").alias("station"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    h = waveforms.headers(c, sta, arrivals)
    return h.select("idx", "station", F.round("km", 5).alias("km"), F.round("p_seconds", 5).alias("p_seconds"), "p_picked", F.round("s_seconds", 5).alias("s_seconds"))


S17 = """WITH v AS (SELECT vec_id AS id, 'S' || label AS station, vec_id * 1000000 AS us, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000)) AS data FROM embeddings),
e AS (SELECT vec_id AS idx, vec_id * 1000000 - 500000 AS start FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT station, us, unnest(range(len(data))) AS i, unnest(data) AS x FROM v),
w AS (SELECT idx, station, start, x, round((us - start) * 64.0 / 1e6) + i AS place FROM e JOIN s ON us > start - 1000000 AND us < start + 3000000)
SELECT idx, station, start AS us, round(1 - count(*) / 192.0, 6) AS gaps, sum(x)::DOUBLE AS total FROM w WHERE place >= 0 AND place < 192 GROUP BY ALL"""


@query("s17_event_windows", S17)
def s17(s, d):
    """Vectors as one-second traces of a station a label, written as an archive of binary day files and read
    back by record; a window round every tenth of them."""
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10_000).cast("double"))
    v = table(s, d, "embeddings").select(F.concat(F.lit("S"), F.col("label").cast("string")).alias("station"), F.lit("HHZ").alias("channel"), (F.col("vec_id") * 1_000_000).alias("us"), F.lit(64.0).alias("rate"), samples.alias("data"))
    folder = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/archive-{uuid.uuid4().hex}"
    seed.write_days(v, folder).count()
    s.dataSource.register(seed.SeedRecords)
    traces = s.read.format("seed_records").load(folder).select("station", "channel", "us", "rate", "data")
    events = table(s, d, "embeddings").filter("vec_id % 10 = 0").select(F.col("vec_id").alias("idx"), (F.col("vec_id") * 1_000_000 + 500_000).alias("us"))
    w = waveforms.windows(events, traces, before=1_000_000, after=2_000_000)
    return w.select("idx", "station", "us", r6(F.col("gaps"), "gaps"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("x09_geodesic")
def x09(s, d):
    return stations(s, d).select("id", F.round(geo.geodesic_km(F.lit(35.5), F.lit(128.5), F.col("lat"), F.col("lon")), 6).alias("km"))


def _utm_sql(lat: str, lon: str, zone: int) -> tuple[str, str]:
    a, f = geo.WGS84
    n = f / (2 - f)
    r = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996 / 1000
    k = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    turn, q = f"radians({lon} - {6 * zone - 183})", f"sin(radians({lat}))"
    t = f"sinh(atanh({q}) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * {q}))"
    xi, eta = f"atan2({t}, cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + {t} ** 2))"
    east = f"{eta} + " + " + ".join(f"{c!r}::DOUBLE * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j, c in enumerate(k))
    north = f"{xi} + " + " + ".join(f"{c!r}::DOUBLE * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j, c in enumerate(k))
    return f"500 + {r!r}::DOUBLE * ({east})", f"{r!r}::DOUBLE * ({north})"


@query("x10_utm", with_("stations", "SELECT id, round({}, 6) AS east, round({}, 6) AS north FROM stations".format(*_utm_sql("lat", "lon", 52))))
def x10(s, d):
    east, north = geo.utm_km(F.col("lat"), F.col("lon"), 52)
    return stations(s, d).select("id", r6(east, "east"), r6(north, "north"))


@query("x11_array_chain", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings), t AS (SELECT vec_id, n, v, list_transform(range(n), lambda i: v[i + 1] * CASE WHEN least(i, n - 1 - i) < greatest(floor(n * 0.1), 1) THEN 0.5 * (1 - cos(pi() * least(i, n - 1 - i) / greatest(floor(n * 0.1), 1))) ELSE 1.0 END) AS t FROM e) SELECT vec_id, round(list_sum(list_transform(t, lambda x: abs(x))), 6) AS tapered, round(list_sum(list_transform(range(0, n, 4), lambda i: list_avg(v[i + 1:i + 4]) * (i + 1))), 6) AS decimated, round(list_sum(list_transform(range(2 * n - 1), lambda i: (i + 1) * CASE WHEN i % 2 = 0 THEN v[i // 2 + 1] ELSE (v[i // 2 + 1] + v[i // 2 + 2]) / 2 END)), 5) AS interpolated FROM t")
def x11(s, d):
    v = F.col("embedding").cast("array<double>")
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda x, y: x + y)
    e = table(s, d, "embeddings").select("vec_id", signal.tapered(v, 0.1).alias("t"), signal.decimated(v, 4).alias("d"), signal.interpolated(v, 64.0, 128.0).alias("i"))
    return e.select("vec_id", r6(total("t", lambda x: F.abs(x)), "tapered"), r6(total("d", lambda x, i: x * (4 * i + 1)), "decimated"), F.round(total("i", lambda x, i: x * (i + 1)), 5).alias("interpolated"))


@query("x12_to_precision", with_("catalog", "SELECT idx, round(round_even(mag / 0.1, 0) * 0.1, 6) AS m FROM catalog"))
def x12(s, d):
    return catalog(s, d).select("idx", r6(geo.to_precision(F.col("mag")), "m"))


@query("x13_item_pairs", "WITH a AS (SELECT DISTINCT user_id, event_type AS t FROM events) SELECT x.user_id, x.t AS a, y.t AS b FROM a x JOIN a y ON x.user_id = y.user_id AND x.t < y.t")
def x13(s, d):
    sets = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    return sets.lateralJoin(udf.Pairs(F.col("items").outer())).select("user_id", "a", "b")


@query("x14_theil_slope", "SELECT a.l_orderkey, round(quantile_cont((b.l_extendedprice - a.l_extendedprice) / (b.l_quantity - a.l_quantity), 0.5) * 0.7071067811865476::DOUBLE, 4) AS slope FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_quantity) < (b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_quantity) AND a.l_quantity <> b.l_quantity GROUP BY 1")
def x14(s, d):
    g = udf.theil_slopes(table(s, d, "lineitem"), keys=["l_orderkey"], x="l_quantity", y="l_extendedprice")
    return g.select("l_orderkey", F.round(F.col("slope") * 0.7071067811865476, 4).alias("slope"))


@query("c02_davies_bouldin", with_("catalog", ", p AS (SELECT substr(zone, 1, 1) AS z, lon * 10 + ascii(zone) AS x, lat AS y FROM catalog), c AS (SELECT z, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), s AS (SELECT z, any_value(cx) AS cx, any_value(cy) AS cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s FROM p JOIN c USING (z) GROUP BY 1), w AS (SELECT a.z, max((a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS w FROM s a JOIN s b ON a.z <> b.z GROUP BY 1) SELECT round(avg(w), 5) AS davies_bouldin FROM w"))
def c02c(s, d):
    p = catalog(s, d).select(F.substring("zone", 1, 1).alias("z"), (F.col("lon") * 10 + F.ascii("zone")).alias("x"), F.col("lat").alias("y"))
    return clusters.davies_bouldin(p, cluster="z", features=["x", "y"]).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query("c02_cost_curve")
def c02d(s, d):
    return clusters.cost_curve(stations(s, d).select("lat", "lon"), features=["lat", "lon"], ks=[2, 3, 4, 5], nulls=2)


@query("c02_mixture_bic")
def c02e(s, d):
    return clusters.mixture_bic(stations(s, d).select("lat", "lon"), features=["lat", "lon"], ks=[1, 2])


@query("c10_density_tree")
def c10(s, d):
    """Of the whole catalog, in kilometres, with the settings that located events get."""
    km = [((F.col("lon") - 128) * 91).alias("x"), ((F.col("lat") - 35) * 111).alias("y"), F.col("dep").alias("z")]
    return cluster_tree.density_tree_of_all(catalog(s, d).select("idx", *km), id="idx", coords=["x", "y", "z"], least=30, samples=30)


@query("c15_background")
def c15b(s, d):
    """The probability of each day's events to be background, under the likeliest mu and k."""
    events = catalog(s, d).select((F.col("us") / 8.64e10).alias("t"), "mag")
    return blocks.fitted(events, t="t", m="mag", alpha_ln10=1.0, c=0.01, p=1.1, reference=5.0)[3]


@query("c15_kernel")
def c15k(s, d):
    """All five parameters, fitted to every event of the catalog, and the background they leave."""
    events = catalog(s, d).select((F.col("us") / 8.64e10).alias("t"), "mag")
    return excite.kernel_fitted(events, t="t", m="mag", reference=5.0, rounds=12)[2]


@query("c16_picked")
def c16(s, d):
    t = table(s, d, "embeddings").select(F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("station"), (F.col("vec_id") * 1_000_000).alias("us"), F.lit(64.0).alias("rate"), F.col("embedding").alias("data"))
    return detect.pick(t, detect.energy_ratio(short_s=0.05, long_s=0.3, on=3.0), least=0.0)


@query("c18_located")
def c18(s, d):
    """Arrivals that a ray from a known place gives at five stations; the solver finds it again."""
    own = catalog(s, d).select(F.col("idx").alias("event_idx"), F.col("us").alias("t0"), ((F.col("lon") - 128) * 50).alias("x"), ((F.col("lat") - 35) * 50).alias("y"), F.col("dep").alias("z"))
    places = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("sx"), F.lit(float(b)).alias("sy")) for a, b in ((0, 0), (50, 0), (0, 50), (50, 50), (25, 20)))))
    rays = own.withColumn("p", places).select("event_idx", F.lit("P").alias("phase"), "p.sx", "p.sy", (F.col("t0") + (F.sqrt(F.pow(F.col("x") - F.col("p.sx"), 2) + F.pow(F.col("y") - F.col("p.sy"), 2) + F.pow("z", F.lit(2))) / 6.0 * 1e6).cast("long")).alias("us"))
    return detect.locate(rays, detect.grid_locator(speed={"P": 6.0}, box=((0.0, 50.0), (0.0, 50.0), (0.0, 25.0))))


@query("str07_numbered", "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS k FROM events")
def str07(s, d):
    return streamed(s, d, "events", lambda e: sw.numbered(e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "ts"))).select("day", "event_id", "k")
