"""Instrument responses, sensor breaks and hot groups over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses, select
from ..operators import windows as wn
from ..sources import records
from .registry import query, r6, readings, stations, table, with_

TEXT = "'B050F03     Station:     S' || s_suppkey || chr(10) || 'B052F22     Start date:  1999,001' || chr(10) || 'B053F07     A0: ' || s_nationkey"

DERIVED = rf"""WITH s AS (SELECT 'S' || s_suppkey AS station, s_suppkey % 4 <> 0 AS has, {TEXT} AS text FROM supplier),
c AS (SELECT unnest(['HHE', 'HHN', 'HHZ']) AS channel), t AS (SELECT station AS template, text || chr(10) || channel AS text, channel FROM s, c WHERE has AND station = (SELECT min(station) FROM s WHERE has)),
f AS (SELECT 'S' || l_suppkey AS station, min(l_shipdate)::DATE AS first FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1),
a AS (SELECT s.station, f.first FROM s LEFT JOIN f USING (station) WHERE NOT has)
SELECT 'NS' AS network, station, channel, first, '#' || chr(9) || chr(9) || 'DERIVED from RESP.NS.' || template || '..' || channel || chr(10) || '#' || chr(9) || chr(9) || 'start date = ' || station || ' first day with data; NOT authoritative metadata' || chr(10)
       || regexp_replace(replace(text, template, station), '(?m)^B052F22.*$', 'B052F22     Start date:  ' || strftime(first, '%Y,%j')) AS text, 'derived' AS status FROM a, t WHERE first IS NOT NULL
UNION ALL SELECT NULL, station, NULL, first, NULL, 'no_data' FROM a WHERE first IS NULL"""


@query("k09_derived_responses", DERIVED)
def k09(s, d):
    """Responses of the stations that have none, from a template and their first day with data."""
    own = table(s, d, "supplier").withColumn("station", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    head = F.concat(F.lit("B050F03     Station:     "), "station", F.lit("\nB052F22     Start date:  1999,001\nB053F07     A0: "), F.col("s_nationkey").cast("string"), F.lit("\n"))
    have = own.filter("s_suppkey % 4 <> 0").withColumn("channel", F.explode(F.array(*map(F.lit, ("HHE", "HHN", "HHZ")))))
    have = have.select(F.lit("NS").alias("network"), "station", "channel", F.concat(head, "channel").alias("text"))
    days = table(s, d, "lineitem").filter("l_suppkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station"), F.col("l_shipdate").cast("date").alias("day"))
    return responses.derived(have, own, days)


GAIN = """WITH s AS (SELECT id, 1 + id % 7 AS a, 0.5::DOUBLE + id % 5 AS b, 1000.0::DOUBLE + id AS factor FROM stations),
g AS (SELECT id, a, b, factor, unnest([0.1::DOUBLE, 1.0, 10.0]) AS hz FROM s), w AS (SELECT *, 2 * pi() * hz AS w FROM g),
x AS (SELECT *, [{'re': 0.0::DOUBLE, 'im': 0.0::DOUBLE}, {'re': 0.0, 'im': 0.0}] AS z, [{'re': -a::DOUBLE, 'im': b}, {'re': -a::DOUBLE, 'im': -b}, {'re': -100.0::DOUBLE, 'im': 0.0::DOUBLE}] AS p FROM w),
y AS (SELECT *, degrees(list_sum(list_transform(z, lambda q: atan2(w - q.im, -q.re))) - list_sum(list_transform(p, lambda q: atan2(w - q.im, -q.re)))) AS turn FROM x)
SELECT id, hz, round(log10(factor) + list_sum(list_transform(z, lambda q: log10(sqrt(q.re ** 2 + (w - q.im) ** 2)))) - list_sum(list_transform(p, lambda q: log10(sqrt(q.re ** 2 + (w - q.im) ** 2)))), 6) AS log_gain,
       round(180 - ((180 - turn) - 360 * floor((180 - turn) / 360)), 6) AS degrees FROM y"""


@query("x15_response_gain", "WITH stations AS (SELECT s_suppkey AS id FROM supplier) SELECT * FROM (" + GAIN + ")")
def x15(s, d):
    """Gain and phase of each station's second-order sensor with an amplifier's pole, at three frequencies."""
    own = stations(s, d).select("id", (1 + F.col("id") % 7).cast("double").alias("a"), (0.5 + F.col("id") % 5).alias("b"), (1000.0 + F.col("id")).alias("factor"))
    root = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    zero, a, b = F.lit(0.0), F.col("a"), F.col("b")
    own = own.withColumns({"z": F.array(root(zero, zero), root(zero, zero)), "p": F.array(root(-a, b), root(-a, -b), root(F.lit(-100.0), zero))})
    own = own.withColumn("hz", F.explode(F.array(F.lit(0.1), F.lit(1.0), F.lit(10.0))))
    hz, z, p = F.col("hz"), F.col("z"), F.col("p")
    return own.select("id", "hz", r6(responses.log_gain(hz, z, p, F.col("factor")), "log_gain"), r6(responses.phase(hz, z, p), "degrees"))


BREAKS = """WITH r AS (SELECT l_orderkey AS event_idx, l_linenumber AS line, l_suppkey AS unit, l_shipdate::DATE AS day FROM lineitem),
b AS (SELECT DISTINCT l_suppkey AS unit, l_shipdate::DATE AS day FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 50 = 0)
SELECT event_idx, line, (SELECT count(*) FROM b WHERE b.unit = r.unit AND b.day <= r.day)::INTEGER AS epoch FROM r"""


@query("s20_break_map", BREAKS)
def s20b(s, d):
    """A JSON map of sensor to break days, read as one, gives each reading its epoch (a break's day is after it)."""
    li = table(s, d, "lineitem")
    at = F.col("l_shipdate").cast("date")
    texts = li.filter("l_linenumber = 1 AND l_orderkey % 50 = 0").groupBy("l_suppkey").agg(F.to_json(F.create_map(F.first(F.concat(F.lit("KG.S"), F.col("l_suppkey").cast("string"))), F.array_sort(F.collect_set(at)))).alias("value"))
    breaks = texts.select(F.explode(F.from_json("value", "map<string, array<date>>")).alias("sensor", "breaks"))
    own = li.select(F.col("l_orderkey").alias("event_idx"), F.col("l_linenumber").alias("line"), F.concat(F.lit("KG.S"), F.col("l_suppkey").cast("string")).alias("sensor"), at.alias("day"))
    return own.join(breaks, "sensor", "left").select("event_idx", "line", wn.epoch_ordinal(F.coalesce("breaks", F.array().cast("array<date>")), F.col("day")).cast("int").alias("epoch"))


#: Columns of a relocation line, in their order (fixed).
RELOCATED = ("id", "lat", "lon", "depth", "x", "y", "z", "ex", "ey", "ez", "yr", "mo", "dy", "hr", "mi", "sc", "mag", "nccp", "nccs", "nctp", "ncts", "rcc", "rct", "cid")

_VALUES = ("o_orderkey", "35 + o_orderkey % 7", "128 + o_orderkey % 5", "o_orderkey % 20", "o_orderkey % 11", "o_orderkey % 13", "o_orderkey % 17", "1", "2", "3", "1996", "1 + o_orderkey % 12", "1 + o_orderkey % 28", "o_orderkey % 24", "o_orderkey % 60", "o_orderkey % 60", "2", "o_orderkey % 3", "o_orderkey % 4", "o_orderkey % 5", "o_orderkey % 6", "7", "8", "o_orderkey % 9")


@query("s15_relocated_lines", "SELECT " + ", ".join(f"({v})::DOUBLE AS {n}" for n, v in zip(RELOCATED, _VALUES, strict=True)) + " FROM orders")
def s15b(s, d):
    """All twenty-four columns of relocation lines, written from the catalog with uneven blanks."""
    values = [F.expr(v).cast("string") for v in _VALUES]
    return records.read_columns(table(s, d, "orders").select(F.concat(F.lit("  "), F.concat_ws("   ", *values), F.lit(" ")).alias("value")), list(RELOCATED))


@query("a02_hot_medians", with_("readings", "SELECT line % 2 AS half, round(quantile_cont(ml, 0.5), 6) AS med, count(ml) AS n FROM readings GROUP BY 1"))
def a02h(s, d):
    """Medians of two groups that hold half of all readings each."""
    x = readings(s, d).withColumn("half", F.col("line") % 2)
    return select.percentiles(x, keys=["half"], value="ml", share=0.5, name="m").select("half", r6(F.col("m"), "med"), "n")
