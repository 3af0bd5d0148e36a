import math

import numpy as np
import pandas as pd
import pytest
from catalogflow import cli
from catalogflow.functions import geo, text
from catalogflow.operators import associate, families, graph, joins, rates, robust, sequence, signal, stats
from catalogflow.operators import windows as wn
from catalogflow.plans import augment
from catalogflow.plans import queries as core
from catalogflow.sources import records, schemas, tables
from pyspark.sql import functions as F

US = 1_000_000


@pytest.fixture(autouse=True)
def prepared(spark):
    core.prepare(spark)


def test_range_join_meets_each_pair_once(spark):
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1000, 200).tolist(), draw.integers(0, 1000, 300).tolist()
    left, right = spark.createDataFrame(list(enumerate(a)), "i long, at long"), spark.createDataFrame(list(enumerate(b)), "j long, t long")
    got = sorted((r.i, r.j) for r in joins.range_join(left, right, at="at", time="t", before=3, after=20).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x - 3 <= y <= x + 20)


def test_nearest_ties_go_to_the_earlier_and_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([(1, 100), (2, 200), (3, 900)], "i long, at long")
    right = spark.createDataFrame([(7, 95), (8, 105), (9, 210), (6, 190)], "j long, t long")
    got = {r.i: r.j for r in joins.nearest_left(left, right, at="at", time="t", tolerance=10, left_id="i", right_id="j").collect()}
    assert got == {1: 7, 2: 6, 3: None}


def test_epochs_are_half_open(spark):
    e = spark.createDataFrame([("A", 0, 10, "Aa"), ("A", 10, 20, "Ab")], "k string, s long, e long, v string")
    p = spark.createDataFrame([("A", 9), ("A", 10), ("A", 20), ("B", 5)], "k string, at long")
    got = sorted((r.k, r.at, r.v) for r in joins.in_epoch(p, e, key="k", at="at", start="s", end="e", value="v", fallback="k").collect())
    assert got == [("A", 9, "Aa"), ("A", 10, "Ab"), ("A", 20, "A"), ("B", 5, "B")]


def test_ambiguous_picks(spark):
    c = spark.createDataFrame([("p", 1, 0.10), ("p", 2, -0.29), ("q", 1, 0.0), ("q", 2, 0.2), ("r", 3, 0.9)], "pick string, event long, residual double")
    clear, decided = wn.resolve_ambiguous(c, pick=["pick"], residual="residual", event="event", tie=0.2)
    assert sorted((r.pick, r.event) for r in clear.collect()) == [("q", 1), ("r", 3)]
    assert {r.pick: r.decision for r in decided.collect()} == {"p": "dropped_ambiguous", "q": "best_match_wins"}
    clear, decided = wn.resolve_ambiguous(c.limit(0), pick=["pick"], residual="residual", event="event", tie=0.2)
    assert clear.count() == decided.count() == 0


def test_augmentation_keeps_what_was_there(spark):
    events = spark.createDataFrame([(1, 100 * US, 35.0, 128.0, 10.0), (2, 103 * US, 35.2, 128.2, 8.0)], "idx long, us long, lat double, lon double, dep double")
    sta = spark.createDataFrame([("KG.AAA", 35.1, 128.1), ("KG.BBB", 35.4, 128.3)], "station string, slat double, slon double")
    assigned = spark.createDataFrame([(1, "KG.AAA", "P")], "idx long, station string, phase string")

    def arrival(lat, lon, dep, slat, slon, v):
        a = math.sin(math.radians(slat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(slat)) * math.sin(math.radians(slon - lon) / 2) ** 2
        return math.hypot(2 * 6371 * math.asin(math.sqrt(a)), dep) / v

    t = lambda o, s, v: int(o * US + arrival(*s, v) * US)
    picks = [(1, "KG.AAA", "P", "P", t(100, (35.0, 128.0, 10.0, 35.1, 128.1), 5.98), 0.9), (2, "KG.AAA", "S", "S", t(100, (35.0, 128.0, 10.0, 35.1, 128.1), 3.4), 0.3), (3, "KG.BBB", "P", "P", t(103, (35.2, 128.2, 8.0, 35.4, 128.3), 5.98), 0.29), (4, "KG.ZZZ", "P", "P", 101 * US, 0.9)]
    frame = spark.createDataFrame(picks, "pick_id long, station string, phase string, kind string, pus long, prob double")
    new, _ = augment.augment(events, assigned, sta, frame)
    got = sorted((r.idx, r.station, r.phase, r.source) for r in new.collect())
    assert got == [(1, "KG.AAA", "P", "associated"), (1, "KG.AAA", "S", "augmented")]


def test_median_polish_on_an_exact_table(spark):
    cells = [(e, u, m + s) for e, m in ((1, 1.0), (2, 2.0), (3, 3.0)) for u, s in (("A", 0.1), ("B", 0.0), ("C", -0.1))]
    level, fix = robust.median_polish(spark.createDataFrame(cells, "e long, u string, v double"), event="e", unit="u", value="v", rounds=5, tolerance=1e-6)
    assert {r.u: round(r.correction, 9) for r in fix.collect()} == {"A": 0.1, "B": 0.0, "C": -0.1}
    assert {r.e: round(r.level, 9) for r in level.collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_change_points_find_a_step(spark):
    draw = np.random.default_rng(0)
    v = np.concatenate([draw.normal(0, 0.05, 150), draw.normal(0.5, 0.05, 150)])
    frame = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "k string, t long, v double")
    got = robust.change_points(frame, keys=["k"], at="t", value="v", least=40, tests=60, level=0.05).collect()
    assert len(got) == 1 and abs(got[0]["at"] - 150) <= 8 and got[0].step > 0.4
    flat = robust.change_points(frame.withColumn("v", F.lit(1.0)), keys=["k"], at="t", value="v", least=40, tests=10)
    assert flat.count() == 0


def test_plane_fit_finds_a_dipping_plane(spark):
    draw = np.random.default_rng(2)
    xy = draw.uniform(-5, 5, (400, 2))
    pts = [("f", float(x), float(y), float(x + draw.normal(0, 0.01))) for x, y in xy]  # 45 degrees
    got = robust.plane_fit(spark.createDataFrame(pts, "k string, x double, y double, z double"), keys=["k"]).first()
    assert abs(got.dip - 45) < 1 and got["shape"] == "planar"


def test_components_on_chains_and_stars(spark):
    order = np.random.default_rng(3).permutation(400).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, k) for k in range(1001, 1060)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(400), *range(1000, 1060), 5000]], "id long")
    got = {r.id: r.family for r in graph.connected(edges, nodes, a="a", b="b", id="id").collect()}
    assert {got[i] for i in range(400)} == {0} and {got[i] for i in range(1000, 1060)} == {1000} and got[5000] == 5000


def test_depths_of_a_chain_and_a_star(spark):
    f = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None), (10, 9), (11, 9)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in graph.depths(f, id="id", parent="parent").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (9, 0), 10: (9, 1), 11: (9, 1)}


def test_association_takes_every_station(spark, tmp_path):
    """Users from 20,000 on are stations like all others."""
    from datetime import datetime, timedelta

    users = [20_000 + 100 * i for i in range(16)]
    day = datetime(2024, 1, 5, 12)
    rows = [(i, u, ("view", "click")[i % 2], day + timedelta(seconds=i), 1.0) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = core.queries()["c17_association"](spark, str(tmp_path)).collect()
    assert [(r.n_picks, r.n_p, r.n_s) for r in got] == [(16, 8, 8)]


def test_nearest_stations_equal_brute_force(spark):
    """More stations than were once allowed, lone events far from all, both sides of 180 degrees, near a pole."""
    draw = np.random.default_rng(8)
    la, lo = np.r_[draw.uniform(35, 37, 60_000), 10.0, -20.0, 89.0], np.r_[draw.uniform(126, 130, 60_000), 179.9, -179.5, 10.0]
    at = [(36.0, 128.0), (35.0, 126.0), (36.7, 140.0), (10.0, -179.9), (-18.0, 179.9), (88.9, -170.0), (-89.0, 0.0)] + [(float(a), float(b)) for a, b in zip(draw.uniform(35, 37, 40), draw.uniform(126, 130, 40), strict=True)]
    events = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "idx long, lat double, lon double")
    sta = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(la)), "slat": la, "slon": lo}))
    got = {}
    for r in augment.nearest_stations(events, sta, n=3).collect():
        got.setdefault(r.idx, []).append((r.km, r.id))
    a, b = np.radians(la), np.radians(lo)
    for i, (y, x) in enumerate(at):
        h = np.sin((a - math.radians(y)) / 2) ** 2 + math.cos(math.radians(y)) * np.cos(a) * np.sin((b - math.radians(x)) / 2) ** 2
        km = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))
        assert [k for _, k in sorted(got[i])] == np.argsort(km)[:3].tolist()


def test_change_points_are_placed_finely(spark):
    draw = np.random.default_rng(5)
    n, k = 6000, 2225
    v = draw.normal(0, 0.05, n) + np.where(np.arange(n) >= k, 1.0, 0.0)
    frame = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(n), "v": v}))
    got = robust.change_points(frame, keys=["k"], at="t", value="v", least=50, tests=300, level=0.01, most=1).collect()
    assert len(got) == 1 and abs(got[0].at - k) <= (n - 100) // 250 and got[0].p < 0.01


def test_part_families_take_every_row(spark):
    from .conftest import SF

    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        a, b = sorted((root(r.l_partkey), root(r.l_suppkey + 1_000_000)))
        up[b] = a
    got = {r.id: r.family for r in core.queries()["c04_families"](spark, SF).collect()}
    assert got == {i: root(i) for i in up}


def test_declustered_families_are_the_components_of_all_events(spark):
    from catalogflow.plans.queries_more import parents

    from .conftest import SF

    n, p = parents(spark, SF)
    want = graph.connected(p.filter("log_eta < -2.5"), n.select("idx"), a="idx", b="parent", id="idx")
    got = core.queries()["c04_declustered_families"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_nearest_parent_searches_all_earlier_events(spark):
    """Many events a day, over far more days than a few slices."""
    from catalogflow.plans.queries_more import day_events

    from .conftest import SF

    draw = np.random.default_rng(3)
    n = 3000
    t, x, y, m = draw.integers(0, 900, n).astype(float), draw.uniform(0, 100, n), draw.uniform(0, 100, n), draw.exponential(0.5, n)
    m[t < 20] += 3
    got = {r.id: r for r in graph.nearest_parent(spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "t": t, "x": x, "y": y, "m": m})), id="id", t="t", x="x", y="y", m="m").collect()}
    assert set(got) == set(np.flatnonzero(t > t.min()).tolist())
    for i, r in got.items():
        old = np.flatnonzero(t < t[i])
        eta = np.log10(t[i] - t[old]) + 1.6 * np.log10(np.maximum(np.hypot(x[i] - x[old], y[i] - y[old]), 0.01)) - m[old]
        assert r.parent == old[eta.argmin()] and r.log_eta == pytest.approx(eta.min())
    assert max(t[i] - t[r.parent] for i, r in got.items()) > 200
    assert day_events(spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    null = families.randomised(spark.createDataFrame([(i, float(i), i / 7) for i in range(500)], "id long, t double, m double"), id="id", t="t", m="m", coords=[])
    assert sorted(r.m for r in null.collect()) == [i / 7 for i in range(500)]


def test_nearest_parent_is_strictly_earlier(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 0.0, 3.0), (3, 1.0, 1.0, 0.0, 2.0)], "id long, t double, x double, y double, m double")
    got = {r.id: r.parent for r in graph.nearest_parent(e, id="id", t="t", x="x", y="y", m="m").collect()}
    assert got == {3: 1}


def test_alignment_and_nudging(spark):
    a = spark.createDataFrame([("d", 1, 0), ("d", 2, 10), ("d", 3, 30)], "k string, i long, t long")
    b = spark.createDataFrame([("d", 7, 2), ("d", 8, 3), ("d", 9, 31)], "k string, i long, t long")
    got = [(r.left_id, r.right_id) for r in sequence.aligned(a, b, keys=["k"], left_id="i", at="t", right_id="i", time="t", tolerance=5).collect()]
    assert sorted(got) == [(1, 7), (3, 9)]
    n = spark.createDataFrame([("d", 1, 5), ("d", 2, 5), ("d", 3, 6), ("d", 4, 50)], "k string, i long, t long")
    assert [r.moved for r in sequence.nudged(n, keys=["k"], id="i", at="t", step=3, width=7).orderBy("i").collect()] == [5, 8, 11, 50]
    assert sequence.best_offset(a.withColumn("t", F.col("t") + 1000), b, at="t", time="t", offsets=[0, 1000, -1000], reach=50) == -1000


def test_chi2_and_poisson():
    assert rates.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert rates.poisson_interval(10, 1.0) == pytest.approx((4.795, 18.390), abs=1e-3)
    assert rates.poisson_interval(0, 2.0)[0] == 0 and rates.chi2_p(3.841, 1) == pytest.approx(0.05, abs=1e-3)


def test_average_linkage(spark):
    p = spark.createDataFrame([("f", 1, 2, 0.9), ("f", 2, 3, 0.8), ("f", 1, 3, 0.1), ("f", 4, 5, 0.7)], "k string, a long, b long, cc double")
    got = {r.id: r.cluster for r in families.average_linkage(p, keys=["k"], least=0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_correlation_peaks_between_samples():
    x = np.sin(np.arange(64) / 5.0) * np.hanning(64)
    cc, lag, zero = signal.lag_correlation(x, np.roll(x, 1), 5)
    assert lag == pytest.approx(-1, abs=0.1) and cc > zero
    assert signal.lag_correlation(x, -x, 0)[2] == pytest.approx(-1) and math.isnan(signal.lag_correlation(x, 0 * x, 2)[0])


def test_association_of_planted_events(spark):
    place = {f"S{i}": (float(10 * (i % 4)), float(10 * (i // 4))) for i in range(12)}
    rows, n = [], 0
    for origin, x, y in ((1000.0, 10.0, 10.0), (86_399.0, 20.0, 10.0)):
        for s, (a, b) in place.items():
            for phase, v in (("P", 6.0), ("S", 3.5)):
                rows.append((n, s, phase, int((origin + math.hypot(a - x, b - y) / v) * US)))
                n += 1
    picks = spark.createDataFrame(rows, "pick_id long, station string, phase string, us long")
    find = associate.grid_associator(place, speed={"P": 6.0, "S": 3.5}, step=10.0, tolerance=0.5, least=6)
    events, assigned = associate.associate(picks, find)
    got = [(r.x, r.y, r.n_picks, r.n_ps) for r in events.orderBy("us").collect()]
    assert got == [(10.0, 10.0, 24, 12), (20.0, 10.0, 24, 12)] and assigned.count() == 48


def test_sources_read_what_sinks_write(spark, tmp_path):
    day = tmp_path / "picks_2020.001.csv"
    day.write_text("station,phase,peak_time,probability\nKG.AAA,P,2020-01-01T00:00:10.000Z,0.3\nKG.BBB,S,2020-01-01T00:00:12.000Z,NaN\n")
    got = tables.read_picks(spark, str(tmp_path), 2020).orderBy("station").collect()
    assert [(r.net, r.code, r.probability) for r in got] == [("KG", "AAA", 0.3), ("KG", "BBB", None)]
    assert tables.read_picks(spark, str(tmp_path), 2020, 2).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_picks(spark, str(tmp_path), 2021)
    assert tables.read_year(spark, str(tmp_path), 2020) == (None, None)
    first = spark.createDataFrame([(1, "a")], "i long, s string")
    assert tables.replace_csv(first, str(tmp_path / "out")) == ""
    back = spark.read.option("header", True).schema("i long, s string").csv(str(tmp_path / "out"))
    old = tables.replace_csv(back.union(first), str(tmp_path / "out"))
    assert old and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    tables.write_parquet(first, str(tmp_path / "p"), {"run": "x"})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and "run" in spark.read.text(str(tmp_path / "p.meta")).first().value


def test_station_xml_and_breaks(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<FDSNStationXML><Network code="KG"><Station code="AAA"><Latitude>35.5</Latitude><Longitude>128.5</Longitude><Elevation>10</Elevation>'
        '<Channel code="HHZ" startDate="2011-01-01T00:00:00" endDate="2015-01-01T00:00:00"/><Channel code="HGZ" startDate="2009-01-01T00:00:00" endDate="2020-01-01T00:00:00"/></Station></Network></FDSNStationXML>'
    )
    r = spark.read.format("xml").option("rowTag", "Network").option("attributePrefix", "_").load(str(tmp_path / "s.xml"))
    assert r.count() == 1
    got = tables.read_station_xml(spark, str(tmp_path / "s.xml")).first()
    assert (got.net, got.sta, got.bands, got.t0.year, got.t1.year) == ("KG", "AAA", "HG/HH", 2011, 2015)
    (tmp_path / "b.json").write_text('{"KG.AAA.HHZ": ["2012-05-01", "2011-01-01"]}')
    assert [str(x) for x in tables.read_breaks(spark, str(tmp_path / "b.json")).first().breaks] == ["2011-01-01", "2012-05-01"]


def test_fixed_width_records(spark):
    line = "20200102030405.67 " + "  35.5000" [1:].rjust(10)
    f = spark.createDataFrame([("   1.50****  7",), ("           x",)], "value string")
    got = records.fixed(f, [("a", 1, 7, "double"), ("b", 8, 4, "double"), ("c", 12, 3, "int")]).collect()
    assert tuple(got[0]) == (1.5, None, 7) and tuple(got[1]) == (None, None, None) and line
    values = " ".join(str(v) for v in (7, 35.1, 128.2, 9.0, 1, 2, 3, 0, 0, 0, 2020, 1, 2, 3, 4, 60.0, 2.5, 0, 0, 5, 5, 0.1, 0.1, 1))
    r = records.read_relocated(spark.createDataFrame([(values,), ("1 2 3",)], "value string")).collect()
    assert len(r) == 1 and r[0].id == 7 and r[0].time.second == 59 and not r[0].linked and len(schemas.RELOCATED) == 24
    days = tables.archive_days(spark.createDataFrame([("/a/AAA/HHZ.D/x.2020.001",), ("/a/AAA/HHZ.D/x.2020.002",), ("/a/AAA/HHN.D/x.2020.001",), ("junk",)], "path string")).collect()
    assert [(d.sta, d.band, d.year, d.days) for d in days] == [("AAA", "HH", 2020, 2)]


def test_station_card(spark):
    f = spark.createDataFrame([("KS", "DAG2", 35.7685, 128.897, 262.0)], "net string, sta string, lat double, lon double, elev double")
    assert f.select(text.station_card(F.col("net"), F.col("sta"), F.col("lat"), F.col("lon"), F.col("elev")).alias("c")).first().c == "DAG2  KS  HHZ  35 46.1100N128 53.8200E 262"


def test_layers_and_laws(spark):
    f = spark.createDataFrame([(15.0,), (14.9,)], "d double").select(geo.layer_speed(F.col("d"), F.lit("P")).alias("v")).collect()
    assert [r.v for r in f] == [6.38, 5.98]
    bands = spark.createDataFrame([("HG/HH",), ("EL/HG",), ("BH",)], "b string").select(text.first_band(F.col("b")).alias("f")).collect()
    assert [r.f for r in bands] == ["HH", "EL", None]


def test_azimuthal_gap(spark):
    f = spark.createDataFrame([("a", 10.0), ("a", 350.0), ("b", 5.0)], "k string, az double")
    assert {r.k: r.gap for r in stats.azimuthal_gap(f, keys=["k"], azimuth="az").collect()} == {"a": 340.0, "b": 360.0}


def test_parsers(capsys):
    assert cli.parse_years("2010-2012,2015,2011") == [2010, 2011, 2012, 2015]
    assert cli.parse_gate("n_p=3")["n_p"] == 3 and cli.parse_gate("")["n_picks"] == 4
    with pytest.raises(ValueError):
        cli.parse_qc("oops=1")
    assert cli.qc_predicate(cli.parse_qc("gap=180")) == "erh < 5.0 AND erz < 5.0 AND gap < 180.0 AND num > 5.0 AND rms < 1.0"
    assert cli.main(["list"]) == 0 and "f01_qc_gate" in capsys.readouterr().out


def test_qc_is_strict_and_nulls_fail(spark):
    f = spark.createDataFrame([(1, 5.0, 1.0, 10.0, 9, 0.1), (2, 1.0, 1.0, 270.0, 9, 0.1), (3, 1.0, 1.0, 10.0, 5, 0.1), (4, 1.0, 1.0, 10.0, 6, 0.1), (5, 1.0, 1.0, 10.0, 9, 1.0), (6, 1.0, 1.0, 10.0, 9, None)], "i long, erh double, erz double, gap double, num int, rms double")
    assert [r.i for r in f.filter(cli.qc_predicate(cli.parse_qc(""))).collect()] == [4]
    assert tables.without_nan(pd and spark.createDataFrame([(float("nan"),)], "x double")).first().x is None
