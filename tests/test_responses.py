"""Responses against complex numbers, and texts derived for stations without one."""

import cmath
import datetime
import math

import pytest
from catalogflow.operators import responses
from pyspark.sql import functions as F


def test_gain_and_phase_equal_complex_numbers(spark):
    sets = [([(0.0, 0.0), (0.0, 0.0)], [(-4.4, 4.4), (-4.4, -4.4)], 1.5e9), ([], [(-100.0, 0.0)], 2.0), ([(-3.0, 2.0), (1.0, -7.0), (0.0, 0.0)], [(-1.0, 0.5)] * 5, 1e-12)]
    frame = spark.createDataFrame([(k, *s) for k, s in enumerate(sets)], "k int, z array<struct<re double, im double>>, p array<struct<re double, im double>>, f double")
    for hz in (0.01, 1.0, 7.5, 200.0):
        for r in frame.select("k", responses.log_gain(F.lit(hz), F.col("z"), F.col("p"), F.col("f")).alias("g"), responses.phase(F.lit(hz), F.col("z"), F.col("p")).alias("d")).collect():
            zeros, poles, factor = sets[r.k]
            h = factor + 0j
            for re, im in zeros:
                h *= 2j * math.pi * hz - complex(re, im)
            for re, im in poles:
                h /= 2j * math.pi * hz - complex(re, im)
            assert r.g == pytest.approx(math.log10(abs(h)), abs=1e-9)
            assert math.cos(math.radians(r.d) - cmath.phase(h)) == pytest.approx(1) and -180 < r.d <= 180


def test_responses_are_derived_marked_and_written(spark, tmp_path):
    text = "B050F03     Station:     N001\nB052F22     Start date:  2020,155\nB053F07     A0: 2\n"
    have = spark.createDataFrame([("NS", "N001", c, text) for c in ("HHE", "HHZ")] + [("NS", "N002", "HHZ", "x")], "network string, station string, channel string, text string")
    needed = spark.createDataFrame([("N001",), ("N201",), ("N202",), ("N201",)], "station string")
    days = spark.createDataFrame([("N201", datetime.date(2022, 8, 26)), ("N201", datetime.date(2022, 8, 25)), ("N001", datetime.date(2010, 1, 1))], "station string, day date")
    found = responses.derived(have, needed, days)
    rows = {(r.station, r.channel): r for r in found.collect()}
    assert sorted(rows, key=str) == [("N201", "HHE"), ("N201", "HHZ"), ("N202", None)] and rows["N202", None].status == "no_data"
    lines = rows["N201", "HHZ"].text.split("\n")
    assert lines[0].startswith("#\t\tDERIVED from RESP.NS.N001..HHZ") and lines[2:5] == ["B050F03     Station:     N201", "B052F22     Start date:  2022,237", "B053F07     A0: 2"]
    assert [r.file for r in responses.write_responses(found, str(tmp_path / "a"), dry_run=True).orderBy("file").collect()] == ["RESP.NS.N201..HHE", "RESP.NS.N201..HHZ"]
    assert not (tmp_path / "a").exists()
    told = {r.file: r.bytes for r in responses.write_responses(found, f"file://{tmp_path}/a").collect()}
    assert {p.name: p.stat().st_size for p in (tmp_path / "a").iterdir()} == told
    both = responses.merged([have, found.filter("text IS NOT NULL").select(*have.columns), have.withColumn("text", F.lit("late"))])
    assert {(r.station, r.channel): r.source for r in both.collect()} == {("N001", "HHE"): 0, ("N001", "HHZ"): 0, ("N002", "HHZ"): 0, ("N201", "HHE"): 1, ("N201", "HHZ"): 1}
    assert responses.derived(have.limit(0), needed, days, template="N001").filter("text IS NOT NULL").count() == 0
