"""Queries on tables whose groups are larger than those of the smallest tables, against their SQL."""

import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from catalogflow.operators import blocks, detect, families, graph, joins, overlap, robust
from catalogflow.plans import queries as core
from pyspark.sql import functions as F

from .conftest import SF
from .test_queries import rows


@pytest.fixture(autouse=True)
def prepared(spark):
    core.prepare(spark)


def made(folder, **tables):
    """A folder of tables, each made by SQL over the smallest ones."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql.format(SF)}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def same(spark, folder, name, *tables):
    """The query's rows, if they are those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    frame = core.queries()[name](spark, folder)
    got = frame.collect()
    assert rows(frame.columns, got) == rows(names, found.fetchall())
    return got


def test_more_events_in_a_second_than_latin_letters(spark, tmp_path):
    orders = "SELECT range AS o_orderkey, TIMESTAMP '1998-02-06 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM range(400)"
    got = same(spark, made(tmp_path, orders=orders), "w01_same_second_ids", "orders")
    assert len({r.event_key for r in got}) == 400


def test_numbers_of_a_day_of_several_frames(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 25013) SECOND AS ts FROM range(25000)"
    got = same(spark, made(tmp_path, events=events), "str07_numbered", "events")
    assert len(got) == 25000


def test_nearest_neighbours_of_points_that_share_places(spark):
    frame = spark.range(20_000).select("id", (F.col("id") % 3 * 2.0).alias("x"), F.lit(1.0).alias("y")).union(spark.createDataFrame([(20_000, 5.0, 1.0), (20_001, 9.0, 1.0)], "id long, x double, y double"))
    got = {r.id: (r.neighbour, r.apart) for r in joins.nearest_neighbour(frame, id="id", coords=["x", "y"]).collect()}
    assert got == {i: (i % 3 if i > 2 else i + 3, 0.0) for i in range(20_000)} | {20_000: (2, 1.0), 20_001: (20_000, 4.0)}


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_time_makes_no_row_a_pair(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 1009) SECOND AS ts, 1 AS user_id, CASE WHEN range % 3 = 0 THEN 'purchase' ELSE 'view' END AS event_type, 9.0 AS value FROM range(3000)"
    folder = made(tmp_path, events=events)
    same(spark, folder, "j03_nearest", "events")
    assert "Join" not in plan(core.queries()["j03_nearest"](spark, folder))


def test_nearest_in_place_makes_no_row_a_pair(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 1009) SECOND AS ts, 1 AS user_id, CASE WHEN range % 3 = 0 THEN 'purchase' ELSE 'click' END AS event_type, 9.0 AS value FROM range(3000)"
    folder = made(tmp_path, events=events)
    same(spark, folder, "j13_time_and_place", "events")
    assert "Join" not in plan(core.queries()["j13_time_and_place"](spark, folder))


def test_a_full_cell_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CELL", 50)
    frame = spark.range(400).select("id", (F.col("id") % 4 * 0.1).alias("x"), F.lit(0.0).alias("y"))
    pairs = joins.grid_pairs(frame, id="id", coords=["x", "y"], reach=0.25)
    assert "__deal" in plan(pairs)
    assert sorted((r.id_a, r.id_b) for r in pairs.collect()) == [(a, b) for a in range(400) for b in range(a + 1, 400) if abs(a % 4 - b % 4) <= 2]


def test_clusters_of_points_that_share_places(spark, monkeypatch):
    met = []
    monkeypatch.setattr(graph, "grid_pairs", lambda points, **kind: met.append(points.count()) or joins.grid_pairs(points, **kind))
    spots = {0: 0.0, 1: 0.5, 2: 1.2, 3: 9.0, 4: 20.0}
    rows_ = [(i, spots[i % 4], 0.0) for i in range(40)] + [(100, spots[4], 0.0), (101, None, 0.0)]
    got = {r.id: r.cluster for r in graph.density_clusters(spark.createDataFrame(rows_, "id long, x double, y double"), id="id", coords=["x", "y"], reach=0.8, least=5).collect()}
    assert got == {i: 3 if i % 4 == 3 else 0 for i in range(40)} | {100: None, 101: None}
    assert met == [5]


def test_candidates_are_not_shuffled_to_be_told_from_assigned_picks(spark, tmp_path):
    events = "SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 4001) SECOND AS ts, range % 7 AS user_id, ['purchase', 'view', 'click'][range % 3 + 1] AS event_type, 100.0 AS value FROM range(600)"
    folder = made(tmp_path, events=events)
    for name in ("j01_orphan_picks", "w04_best_match", "w04_decisions", "w05_one_pick_a_station"):
        assert same(spark, folder, name, "events")
        assert "LeftAnti" not in plan(core.queries()[name](spark, folder))


def test_many_events_reach_the_solver_together(spark):
    places = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (40.0, 40.0), (20.0, 10.0)]
    rows_ = [(e, round(math.dist((5 + e % 30, 25, 8), (*p, 0)) / 6 * 1e6), "P", *p) for e in range(200) for p in places[: 4 + e % 2]]
    arrivals = spark.createDataFrame(rows_, "event_idx long, us long, phase string, sx double, sy double")
    solver, known = detect.grid_locator(speed={"P": 6.0}, box=((0, 40), (0, 40), (0, 20)), rounds=8), detect.LOCATED

    def counted(frame):
        return solver(frame).assign(n=frame["event_idx"].nunique()).astype({"n": "int32"})

    got = detect.locate(arrivals, counted).collect()
    assert len(got) == 200 and known == detect.LOCATED and max(r.n for r in got) > 1
    together = {r.event_idx: tuple(r) for r in detect.locate(arrivals, solver).collect()}
    for e in (0, 1, 29, 199):
        alone = solver(pd.DataFrame([r for r in sorted(rows_) if r[0] == e], columns=arrivals.columns))
        assert together[e] == pytest.approx(tuple(alone.iloc[0]))


def test_slopes_of_small_groups_need_no_python(spark, tmp_path):
    lineitem = "SELECT CASE WHEN range < 300 THEN 0 ELSE 1 + range // 5 END AS l_orderkey, range AS l_linenumber, range AS l_partkey, 1 AS l_suppkey, (range * 7 % 50)::DOUBLE AS l_quantity, (range * 7919 % 10007)::DOUBLE AS l_extendedprice FROM range(2000)"
    folder = made(tmp_path, lineitem=lineitem)
    same(spark, folder, "x14_theil_slope", "lineitem")
    x14 = lambda: core.queries()["x14_theil_slope"](spark, folder)
    assert "theil_slope(" not in plan(x14()) and "size(p" in plan(x14())


def vectors(spark, n, width=63):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(n, width)), 3)
    x[7], x[8], x[11] = x[3], 0.0, -x[5]
    return x, [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)]


def small_blocks(monkeypatch, size=15):
    original = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda *a, **k: original(*a, **{**k, "size": size}))


def test_reversed_pairs_leave_a_task_when_all_parts_are_reversed(spark, tmp_path, monkeypatch):
    small_blocks(monkeypatch)
    _, rows_ = vectors(spark, 150)
    spark.createDataFrame([r for r in rows_ if r[0] != 8], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(core.oracle_sql()["c13_anti_pairs"])
    names = [c[0] for c in found.description]
    frame = core.queries()["c13_anti_pairs"](spark, str(tmp_path))
    assert "Aggregate [a" not in plan(frame)
    got = frame.collect()
    assert got and rows(frame.columns, got) == rows(names, found.fetchall())


def test_linkage_of_vectors_makes_no_row_a_pair(spark, monkeypatch):
    small_blocks(monkeypatch)
    _, rows_ = vectors(spark, 120, 12)
    frame = spark.createDataFrame(rows_, "id long, g int, v array<double>")
    pairs = blocks.similar(frame, id="id", data="v", keys=["g"], least=0.1).withColumn("cc", F.col("cc0")).checkpoint()
    links = blocks.links(frame, id="id", data="v", keys=["g"], least=0.5)
    told = lambda edges: sorted(map(tuple, graph.connected(edges, frame, a="a", b="b", id="id").collect()))
    assert told(links) == told(pairs.filter("cc >= 0.5")) and links.count() < pairs.filter("cc >= 0.5").count()
    monkeypatch.setattr(families, "FLOATS", 100)
    of = pairs.join(frame.select(F.col("id").alias("a"), "g"), "a")
    for least in (0.3, 0.45, 0.7):
        want = {r.id: r.cluster for r in families.average_linkage(of, keys=["g"], least=least).collect()}
        got = {r.id: r.cluster for r in families.average_linkage_of(frame, id="id", data="v", keys=["g"], least=least, floor=0.1).collect()}
        assert {i: got[i] for i in want} == want and got[8] == 8 and len(got) == 120


def test_near_duplicates_move_no_sets_and_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(overlap, "OWN", 20)
    events = "SELECT {} AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 9001) SECOND AS ts, CASE WHEN range % 50 = 0 THEN NULL ELSE range % 23 END AS user_id, ['purchase', 'view', 'click', 'view'][range % 4 + 1] AS event_type, 9.0 AS value FROM range(900)"
    for part, id_ in (("plain", "range"), ("twice", "CASE WHEN range % 100 = 8 THEN 4 ELSE range END")):
        (tmp_path / part).mkdir()
        folder = made(tmp_path / part, events=events.format(id_))
        assert len(same(spark, folder, "j20_near_duplicates", "events")) > 5000
        assert ("collect_set" in plan(core.queries()["j20_near_duplicates"](spark, folder))) == (part == "twice")


@pytest.mark.parametrize(("reach", "depth"), [(1.0, 0.5), (0.3, 2.0), (0.6, 0.0)])
def test_merging_by_place_joins_cells(spark, monkeypatch, reach, depth):
    monkeypatch.setattr(families, "PAIRS", 50)
    draw = np.random.default_rng(7)
    x = np.round(np.concatenate([draw.normal((0, 0, 5), (0.5, 0.2, 0.4), (250, 3)), draw.uniform((-9, -9, 0), (9, 9, 10), (150, 3)), [(i / 10, 7.0, 3.0) for i in range(30)]]), 1)
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0), (901, math.nan, 1.0, 1.0)], "f long, x double, y double, z double")
    up = list(range(len(x)))
    for i, p in enumerate(x):
        for j in np.flatnonzero((np.sqrt((x[:, 0] - p[0]) ** 2 + (x[:, 1] - p[1]) ** 2) <= reach) & (np.abs(x[:, 2] - p[2]) <= depth)):
            low, high = sorted((up[i], up[j]))
            up = [low if u == high else u for u in up]
    merged = families.merged_by_place(frame, family="f", x="x", y="y", z="z", reach=reach, depth=depth)
    assert {r.f: r.merged for r in merged.collect()} == dict(enumerate(up)) | {900: 900, 901: 901}


def test_merging_by_place_makes_no_row_a_pair(spark, monkeypatch):
    edges = []
    original = graph.connected
    monkeypatch.setattr(graph, "connected", lambda e, *a, **k: edges.append(e.count()) or original(e, *a, **k))
    frame = spark.range(3000).select(F.col("id").alias("f"), (F.col("id") % 50 * 0.01).alias("x"), (F.col("id") % 7 * 0.01).alias("y"), F.lit(1.0).alias("z"))
    assert {r.merged for r in families.merged_by_place(frame, family="f", x="x", y="y", z="z", reach=2.0, depth=1.0).collect()} == {0}
    assert sum(edges) == 0


def test_headers_are_dealt_to_more_tasks_as_arrivals_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "SPREAD", 100)
    folder = made(tmp_path, lineitem="SELECT * FROM '{}/lineitem.parquet' LIMIT 2000", orders="SELECT * FROM '{}/orders.parquet'", supplier="SELECT * FROM '{}/supplier.parquet'")
    same(spark, folder, "k06_headers", "lineitem", "orders", "supplier")
    optimized = core.queries()["k06_headers"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[idx#\d+L?\], 20\b", optimized)


def test_polish_sends_few_readings_and_equals_plain_rounds(spark, monkeypatch):
    """Packed events give what the rounds by joins give, for means and medians, ties and events of one reading too."""
    draw = np.random.default_rng(5)
    rows = [(f"e{e}", int(u), float(np.round(e % 7 + u * 0.1 + draw.normal(0, 0.3), 2))) for e in range(300) for u in draw.integers(0, 12, draw.integers(1, 7))]
    frame = spark.createDataFrame(rows, "e string, u int, v double").repartition(3)
    for fit, rounds in ((robust.median_polish, 8), (robust.median_polish, 1), (robust.two_way_means, 6), (robust.two_way_means, 100)):
        found = []
        for many in (0, 4_000_000):
            monkeypatch.setattr(robust, "PACKED_UNITS", many)
            level, fix = fit(frame, event="e", unit="u", value="v", rounds=rounds)
            found.append(({r.e: r.level for r in level.collect()}, {r.u: r.correction for r in fix.collect()}))
        assert found[1][0] == pytest.approx(found[0][0], abs=1e-9) and found[1][1] == pytest.approx(found[0][1], abs=1e-9)
    packed, units = robust._packed(frame, "e", "u", "v")
    assert packed.count() == len({r[0] for r in rows}) and units.count() == len({r[1] for r in rows})
    assert robust._packed(frame.unionByName(spark.createDataFrame([(None, 1, 1.0)], frame.schema)), "e", "u", "v") is None


def test_modes_are_fitted_to_counted_values(spark, monkeypatch):
    """The fit of two modes takes equal values once, and is the same from fewer bins."""
    from catalogflow.operators import clusters

    draw = np.random.default_rng(3)
    v = np.round(np.concatenate([draw.normal(1, 0.4, 3000), draw.normal(3, 0.6, 2000)]), 2)
    frame = spark.createDataFrame([(float(x),) for x in v], "v double")
    held = []
    real = clusters.written
    monkeypatch.setattr(clusters, "written", lambda f: held.append(real(f)) or held[-1])
    one = clusters.valley(frame, value="v").first()
    assert held[0].count() == len(set(v.tolist())) and held[0].agg(F.sum("n")).first()[0] == len(v)
    monkeypatch.setattr(clusters, "SUMMARY", 100)
    two = clusters.valley(frame, value="v").first()
    assert tuple(two) == pytest.approx(tuple(one), abs=1e-3)
    assert one.low == pytest.approx(1, abs=0.05) and one.high == pytest.approx(3, abs=0.1) and 1 < one.cut < 3


def test_late_picks_of_one_bucket_are_few_rows(spark, monkeypatch):
    from catalogflow.streaming import windows as sw

    draw = np.random.default_rng(4)
    frame = lambda name, n: spark.createDataFrame([(i, float(t)) for i, t in enumerate(np.round(draw.uniform(0, 3000, n)))], f"{name} long, s double").withColumn("ts", F.timestamp_seconds("s"))
    o, p = frame("idx", 300), frame("pick_id", 900)
    want = sorted((a.idx, b.pick_id) for a in o.collect() for b in p.collect() if -5 <= b.s - a.s <= 600)
    for pack, pairs in ((10_000, 1_000_000), (7, 50)):
        monkeypatch.setattr(sw, "PACK", pack)
        monkeypatch.setattr(sw, "PAIRS", pairs)
        got = sw.late_picks(o, p, after_s=600)
        assert sorted((r.idx, r.pick_id) for r in got.collect()) == want
        assert got.columns == ["idx", "origin_ts", "pick_id", "pick_ts"]
    packed = sw._packs(p.select("pick_id", F.unix_micros("ts").alias("us"), F.floor(F.col("s") / 605).alias("b")), "pick_id")
    assert packed.filter("size(ids) > 7").isEmpty() and packed.agg(F.sum(F.size("ids"))).first()[0] == 900
