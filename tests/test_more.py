"""Values of what has no SQL: fits, trees, solvers, hooks, waveforms and the commands on files."""

import json
import math
import random

import numpy as np
import pytest
from catalogflow import cli
from catalogflow.functions import geo, udf
from catalogflow.operators import blocks, cluster_tree, clusters, detect, families, graph, rates, robust, sequence, signal, stats
from catalogflow.operators import joins as jn
from catalogflow.operators import windows as wn
from catalogflow.plans import commands, queries
from catalogflow.sources import records, tables, waveforms

from pyspark.sql import functions as F

from .conftest import SF

DAY = 86_400_000_000


@pytest.fixture(autouse=True)
def _checkpoints(spark):
    queries.prepare(spark)


def cloud(seed, axes, spread, n=400):
    """Points spread along given axes."""
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, 3)) * spread) @ np.array(axes, float)


def test_planes_lines_and_blobs(spark):
    strike, dip = math.radians(30), math.radians(60)
    along = [math.sin(strike), math.cos(strike), 0]
    down = [math.cos(strike) * math.cos(dip), -math.sin(strike) * math.cos(dip), -math.sin(dip)]
    across = np.cross(along, down)
    shapes = {"plane": (4, 3, 0.2), "line": (5, 0.4, 0.3), "blob": (2, 1.9, 1.8)}
    rows = [(k, *map(float, p)) for k, s in shapes.items() for p in cloud(1, [along, down, across], s)] + [("few", 0.0, 0.0, float(i)) for i in range(3)]
    got = {r.k: r for r in robust.plane_fit(spark.createDataFrame(rows, "k string, x double, y double, z double"), keys=["k"]).collect()}
    assert got["plane"].shape == "planar" and got["plane"].strike == pytest.approx(30, abs=3) and got["plane"].dip == pytest.approx(60, abs=3)
    assert got["plane"].L1 == pytest.approx(8, rel=0.15)
    assert got["line"].shape == "linear" and got["line"].strike == pytest.approx(30, abs=3) and got["line"].dip is None
    assert got["blob"].shape == "blob" and got["blob"].strike is None and got["few"].shape == "n/a"


def test_migration_follows_the_axis(spark):
    rows = [("m", 3.0 * t + 0.01 * (t % 3), 4.0 * t, float(t)) for t in range(50)]
    r = robust.migration(spark.createDataFrame(rows, "k string, x double, y double, days double"), keys=["k"]).first()
    assert r.rate == pytest.approx(5, rel=1e-3) and r.r == pytest.approx(1, abs=1e-4)


def test_robust_slope_leaves_out_what_is_off(spark):
    draw = random.Random(1)
    rows = []
    for family, true in (("a", 1.73), ("b", 0.8)):
        for pair in range(8):
            shift = draw.uniform(-5, 5)
            for _ in range(12):
                x = draw.uniform(0, 1)
                y = true * x + shift + draw.gauss(0, 0.005) + (draw.uniform(1, 2) if draw.random() < 0.03 else 0)
                rows.append((family, pair, x + shift, y))
    rows += [("c", 0, 1.0, 2.0), ("c", 0, 2.0, 4.0)]
    frame = spark.createDataFrame(rows, "k string, pair int, x double, y double")
    got = {r.k: r for r in robust.robust_slope(frame, keys=["k"], pair="pair", x="x", y="y").collect()}
    assert got["a"].slope == pytest.approx(1.73, abs=0.1) and got["a"].status == "ok" and got["a"].left_out > 0.01 and got["a"].mad < 0.1
    assert got["a"].poisson == pytest.approx((1.73**2 - 2) / (2 * (1.73**2 - 1)), abs=0.1)
    assert got["b"].status == "unphysical" and got["c"].status == "under_determined"


def test_two_way_means_are_least_squares(spark):
    draw = np.random.default_rng(2)
    cells = sorted({(int(e), int(u)) for e, u in zip(draw.integers(0, 30, 200), draw.integers(0, 8, 200), strict=True)})
    rows = [(e, u, float(e * 0.1 + (u - 3) * 0.2 + draw.normal(0, 0.05))) for e, u in cells]
    level, fix = robust.two_way_means(spark.createDataFrame(rows, "e int, u int, v double"), event="e", unit="u", value="v")
    a = np.zeros((len(rows), 38))
    for k, (e, u, _) in enumerate(rows):
        a[k, e] = a[k, 30 + u] = 1
    sol = np.linalg.lstsq(a, np.array([r[2] for r in rows]), rcond=None)[0]
    counts = np.bincount([u for _, u in cells], minlength=8)
    shift = (sol[30:] * counts).sum() / counts.sum()
    assert {r.u: r.correction for r in fix.collect()} == pytest.approx(dict(enumerate(sol[30:] - shift)), abs=1e-6)
    assert {r.e: r.level for r in level.collect()} == pytest.approx({e: sol[e] + shift for e in {e for e, _ in cells}}, abs=1e-6)


def test_detection_model_finds_its_own_parameters(spark):
    draw = np.random.default_rng(5)
    m = draw.exponential(1 / (1.0 * math.log(10)), 200_000) + 0.5
    seen = draw.random(len(m)) < np.array([0.5 * (1 + math.erf((x - 1.2) / 0.25 / math.sqrt(2))) for x in m])
    h = np.unique(np.round(m[seen] * 10).astype(int), return_counts=True)
    frame = spark.createDataFrame([("z", int(b), int(n)) for b, n in zip(*h, strict=True)], "k string, m10 int, n long")
    r = robust.detection_model(frame, keys=["k"], boots=5).first()
    assert r.b == pytest.approx(1.0, abs=0.08) and 1.4 <= r.mc <= 2.2 and r.mu == pytest.approx(1.2, abs=0.2) and r.mc_std < 0.3
    assert robust.detection_model(frame.limit(1).withColumn("n", F.lit(5)), keys=["k"]).first().mc is None


def test_pairs_by_blocks_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 16))
    frame = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g int, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(90):
        for j in range(i + 1, 90):
            if i % 2 == j % 2:
                cc = {s: float(unit[i][max(s, 0) : 16 + min(s, 0)] @ unit[j][max(-s, 0) : 16 - max(s, 0)]) for s in (0, -1, 1, -2, 2)}
                best = max(cc.values())
                want[i, j] = (best, next(s for s in cc if cc[s] >= best - 1e-12), cc[0], min(cc.values()))
    original = blocks.meet
    small = lambda *a, **k: original(*a, **{**k, "size": 20})
    for meet in (original, small):
        blocks.meet = meet
        try:
            got = {(r.a, r.b): (r.cc, r.lag, r.cc0, r.cc_neg) for r in blocks.similar(frame, id="id", data="v", keys=["g"], lags=2).collect()}
            some = {(r.a, r.b) for r in blocks.similar(frame, id="id", data="v", keys=["g"], lags=2, least=0.5).collect()}
            points = spark.createDataFrame([(i, float(v[0]), float(v[1])) for i, v in enumerate(x)], "id long, x double, y double")
            counts = {round(r.radius, 6): r.n for r in blocks.correlation_integral(points, id="id", coords=["x", "y"], radii=[0.1, 0.5, 2.0]).collect()}
            events = spark.createDataFrame([(float(i // 2), float(i % 5)) for i in range(120)], "t double, m double")
            rate = {r.t: r.rate for r in blocks.excitation(events, t="t", m="m", mu=0.1, k=0.5, alpha_ln10=1.0, c=0.01, p=1.1, reference=2.0).collect()}
        finally:
            blocks.meet = original
        assert set(got) == set(want)
        assert all(got[k][1] == want[k][1] and got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        assert some == {k for k, v in want.items() if v[0] >= 0.5}
        apart = [math.dist(x[i][:2], x[j][:2]) for i in range(90) for j in range(i + 1, 90)]
        assert counts == {r: sum(a < r for a in apart) for r in (0.1, 0.5, 2.0)}
        for t in (0.0, 1.0, 59.0):
            assert rate[t] == pytest.approx(0.1 + sum(0.5 * 10 ** (i % 5 - 2.0) * (t - i // 2 + 0.01) ** -1.1 for i in range(120) if i // 2 < t))
    mean = {r.g: r.mean_cc for r in blocks.mean_within(frame, data="v", keys=["g"]).collect()}
    assert mean == pytest.approx({g: np.mean([v[2] for k, v in want.items() if k[0] % 2 == g]) for g in (0, 1)})


def test_excitation_fits_are_the_likeliest(spark):
    draw = np.random.default_rng(15)
    t = np.sort(np.concatenate([draw.uniform(0, 100, 60), *(x + draw.exponential(0.5, 4) for x in draw.uniform(0, 90, 20))]))
    m = draw.exponential(0.4, len(t)) + 2
    kind = {"alpha_ln10": 0.8, "c": 0.05, "p": 1.2, "reference": 2.0}
    mu, k, value, of = blocks.fitted(spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, m, strict=True)], "t double, m double"), t="t", m="m", **kind)
    w = 10 ** (0.8 * (m - 2.0))
    sums = np.array([(w[t < x] * (x - t[t < x] + 0.05) ** -1.2).sum() for x in t])
    whole = (w * (0.05**-0.2 - (t[-1] - t + 0.05) ** -0.2) / 0.2).sum()
    at = lambda a, b: np.log(a + b * sums).sum() - a * (t[-1] - t[0]) - b * whole
    assert value == pytest.approx(at(mu, k), rel=1e-9)
    assert all(at(mu * a, k * b) <= value + 1e-6 for a in (0.97, 1, 1.03) for b in (0.97, 1, 1.03))
    share = sorted((r.t, r.background) for r in of.collect())
    assert [b for _, b in share] == pytest.approx(mu / (mu + k * sums))


def test_nearest_neighbours_without_a_reach(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 0.01, (60, 2)), [[50.0, 50.0], [-80.0, 3.0], [50.0, 50.0]]])
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {r.id: (r.neighbour, r.apart) for r in jn.nearest_neighbour(frame, id="id", coords=["x", "y"]).collect()}
    for i in range(len(x)):
        best = min((math.dist(x[i], x[j]), j) for j in range(len(x)) if j != i)
        assert got[i] == (best[1], pytest.approx(best[0]))
    assert jn.nearest_neighbour(frame.limit(1), id="id", coords=["x", "y"]).count() == 0


def test_rolling_percentiles_and_carried_sums_over_buckets(spark):
    draw = random.Random(6)
    rows = [("ab"[i % 2], i, draw.randrange(0, 500), None if draw.random() < 0.1 else draw.random()) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, id long, t long, v double")
    got = {r.id: (r.a, r.b) for r in wn.rolling_percentiles(frame, keys=["k"], at="t", value="v", width=60, shares=[0.5, 0.1], least=5, names=["a", "b"]).collect()}
    for k, i, t, _ in rows:
        own = sorted(v for q, _, u, v in rows if q == k and t - 60 < u <= t and v is not None)
        want = (None, None) if len(own) < 5 else tuple(float(np.percentile(own, s)) for s in (50, 10))
        assert got[i] == (want if want[0] is None else pytest.approx(want))
    run = {r.id: (r.s, r.s_all) for r in wn.carried(frame, keys=["k"], at="t", id="id", width=37, sums={"s": F.col("id")}).collect()}
    prev = {r.id: r.p for r in wn.previous(frame, keys=["k"], at="t", id="id", width=37, value="id", name="p").collect()}
    moved = {r.id: r.moved for r in sequence.nudged(frame, keys=["k"], id="id", at="t", step=3, width=37).collect()}
    for k in "ab":
        own = sorted((t, i) for q, i, t, _ in rows if q == k)
        total, at, last = sum(i for _, i in own), 0, None
        for n, (t, i) in enumerate(own):
            at += i
            assert run[i] == (at, total) and prev[i] == (own[n - 1][1] if n else None)
            last = t if last is None else max(t, last + 3)
            assert moved[i] == last


def walked(x, y, tolerance):
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if abs(x[i][0] - y[j][0]) <= tolerance:
            out.append((x[i][1], y[j][1]))
            i, j = i + 1, j + 1
        elif x[i] < y[j]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("runs", [1, 500])
def test_alignment_in_runs_equals_one_walk(spark, monkeypatch, runs):
    monkeypatch.setattr(sequence, "RUNS", runs)
    draw = random.Random(7)
    a, b = ([(draw.randrange(0, 20 * DAY), k * 1000 + i) for i in range(200)] for k in (1, 2))
    b += [(t + draw.randrange(-3, 4) * 1_000_000, 5000 + i) for i, (t, _) in enumerate(a[:120])]
    left, right = (spark.createDataFrame([("s", i, t) for t, i in x], "k string, id long, t long") for x in (a, b))
    got = sorted((r.left_id, r.right_id) for r in sequence.aligned(left, right, keys=["k"], left_id="id", at="t", right_id="id", time="t", tolerance=10_000_000).collect())
    assert got == sorted(walked(sorted(a), sorted(b), 10_000_000))
    offset = sequence.best_offset(left.withColumn("t", F.col("t") - 32_400_000_000), left, at="t", time="t", offsets=[0, 32_400_000_000, -32_400_000_000], reach=10_000_000)
    assert offset == 32_400_000_000


def test_density_tree_finds_blobs_of_different_density(spark):
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(0, 0.05, (60, 2)), draw.normal(3, 0.4, (60, 2)), draw.uniform(-4, 8, (15, 2))])
    labels = cluster_tree.density_tree_labels(x, 20, 5)
    assert len(set(labels[:60])) <= 2 and np.bincount(labels[:60] + 1).max() >= 55 and np.bincount(labels[60:120] + 1).max() >= 45
    assert set(labels[labels >= 0]) == {0, 1} and np.argmax(np.bincount(labels[:60] + 1)) != np.argmax(np.bincount(labels[60:120] + 1))
    assert (cluster_tree.density_tree_labels(x[:10], 20, 5) == -1).all()
    frame = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, id long, x double, y double")
    got = {r.id: r.cluster for r in cluster_tree.density_tree(frame, keys=["k"], id="id", coords=["x", "y"], least=20, samples=5).collect()}
    assert got == dict(enumerate(labels.tolist()))


def test_cluster_indices(spark):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    frame = spark.createDataFrame([(i, i // 40, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, own int, x double, y double")
    found = {r.id: r.cluster for r in clusters.kmeans(frame, id="id", features=["x", "y"], k=3, starts=3).collect()}
    assert all(len({found[i] for i in range(40 * k, 40 * k + 40)}) == 1 for k in range(3)) and len(set(found.values())) == 3
    curve = clusters.cost_curve(frame, features=["x", "y"], ks=[1 + 1, 3, 4, 5], nulls=2).collect()
    assert [r.k for r in curve if r.knee] == [3] and max(curve, key=lambda r: r.gap).k >= 3 and curve[0].cost > curve[1].cost > curve[3].cost
    bic = {r.k: r.bic for r in clusters.mixture_bic(frame, features=["x", "y"], ks=[1, 2]).collect()}
    assert bic[2] < bic[1]
    assert clusters.silhouette(frame, cluster="own", features=["x", "y"]) > 0.95
    modes = clusters.valley(spark.createDataFrame([(float(v),) for v in np.concatenate([draw.normal(0, 1, 3000), draw.normal(8, 1, 3000)])], "v double"), value="v").first()
    assert modes.low == pytest.approx(0, abs=0.1) and modes.high == pytest.approx(8, abs=0.1) and modes.cut == pytest.approx(4, abs=0.3)


def test_average_linkage_and_merging_by_place(spark):
    draw = np.random.default_rng(10)
    x = draw.normal(size=(24, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    pairs = [(int(i), int(j), float(s[i, j]), "g") for i in range(24) for j in range(i + 1, 24)]
    got = {r.id: r.cluster for r in families.average_linkage(spark.createDataFrame(pairs, "a long, b long, cc double, k string"), keys=["k"], least=0.3).collect()}
    groups = [[i] for i in range(24)]
    while len(groups) > 1:
        best = max((np.mean([s[i, j] for i in a for j in b]), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m)
        if best[0] < 0.3:
            break
        groups[best[1]] += groups.pop(best[2])
    assert {frozenset(g) for g in groups} == {frozenset(i for i in got if got[i] == c) for c in set(got.values())}
    places = [(1, 0.0, 0.0, 5.0), (1, 0.2, 0.0, 5.0), (2, 0.5, 0.0, 5.2), (3, 9.0, 9.0, 5.0), (4, 9.1, 9.0, 30.0)]
    merged = {r.f: r.merged for r in families.merged_by_place(spark.createDataFrame(places, "f long, x double, y double, z double"), family="f", x="x", y="y", z="z", reach=1.0, depth=1.0).collect()}
    assert merged == {1: 1, 2: 1, 3: 3, 4: 4}


def test_randomised_catalogs_keep_sizes_and_ranges(spark):
    events = spark.createDataFrame([(i, float(i), float(i % 7), float(i % 5)) for i in range(200)], "id long, t double, x double, m double")
    again = families.randomised(events, id="id", t="t", m="m", coords=["x"]).collect()
    assert sorted(r.m for r in again) == sorted(float(i % 5) for i in range(200)) and all(0 <= r.t <= 199 and 0 <= r.x <= 6 for r in again)
    assert [r.m for r in sorted(again, key=lambda r: r.id)] != [float(i % 5) for i in range(200)]
    assert sorted(map(tuple, again)) == sorted(map(tuple, families.randomised(events, id="id", t="t", m="m", coords=["x"]).collect()))


def test_rates_by_hand(spark):
    low, high = rates.poisson_interval(10, 2.0)
    assert (low, high) == (pytest.approx(4.795 / 2, abs=1e-3), pytest.approx(18.390 / 2, abs=1e-3)) and rates.poisson_interval(0, 1.0)[0] == 0.0
    draw = np.random.default_rng(1)
    m = np.round((draw.exponential(1 / math.log(10), 40_000) + 1.45) * 10).astype(int)
    thin = m[(m >= 20) | (draw.random(len(m)) < (m - 13) / 8)]
    h = [("z", int(b), int(n)) for b, n in zip(*np.unique(thin, return_counts=True), strict=True)]
    assert rates.ks_completeness(spark.createDataFrame(h, "k string, m10 int, n long"), keys=["k"], limit=0.02).first().mc == pytest.approx(2.0, abs=0.21)
    alike = [(z, b, 50) for z in "ab" for b in range(6)]
    unlike = [(z, b, 90 if (b < 3) == (z == "a") else 10) for z in "ab" for b in range(6)]
    p = [rates.permutation_null(spark.createDataFrame(c, "z string, b int, n long"), zone="z", bin="b", count="n", times=199).first() for c in (alike, unlike)]
    assert p[0].distance == pytest.approx(0, abs=1e-6) and p[0].p > 0.9 and p[1].p == pytest.approx(1 / 200)
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert clusters.adjusted_rand(same, a="a", b="b").first()[0] == 1.0


def test_change_points_test_the_split_that_was_found(spark):
    draw = np.random.default_rng(11)
    rows = [("s", i, float(draw.normal(0.5 if i >= 400 else 0, 0.1))) for i in range(900)] + [("n", i, float(draw.normal(0, 0.1))) for i in range(900)]
    got = robust.change_points(spark.createDataFrame(rows, "k string, t long, v double"), keys=["k"], at="t", value="v", least=100, step=0.08, tests=300).collect()
    assert len(got) == 1 and got[0].k == "s" and abs(got[0]["at"] - 400) <= 10 and got[0].step == pytest.approx(0.5, abs=0.05) and got[0].p == pytest.approx(1 / 301)


def test_geodesics(spark):
    rows = [(0.0, 0.0, 0.0, 1.0, 111.319491), (0.0, 0.0, 1.0, 0.0, 110.574389), (35.5, 128.5, 35.5, 128.5, 0.0), (50.06632, -5.71475, 58.64402, -3.07009, 969.954166)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, km double")
    for r in frame.withColumn("got", geo.geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r.got == pytest.approx(r.km, abs=2e-5)
    east, north = geo.utm_km(F.lit(35.0), F.lit(129.0), 52)
    r = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert r.e == pytest.approx(500, abs=1e-6) and r.n == pytest.approx(3873.043, abs=2e-3)
    azimuth = spark.range(1).select(geo.azimuth_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("a"), geo.source_radius_m(F.lit(4.0)).alias("r")).first()
    assert azimuth.a == pytest.approx(45, abs=0.1) and azimuth.r == pytest.approx((7 / 16 * 10**15.1 / 3e6) ** (1 / 3))


def test_band_passes_and_powers(spark):
    t = np.arange(1024) / 64
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 5 * t)
    kept = signal.band_passed(slow + fast, 64, 2.0, 10.0)
    assert np.abs(kept - fast)[100:-100].max() < 0.1
    frame = spark.createDataFrame([(1, fast.tolist()), (2, (10 * fast).tolist()), (3, slow.tolist())], "id long, v array<double>")
    db = {r.id: r.db for r in signal.band_power(frame, id="id", data="v", rate=64.0, low=2.0, high=10.0, segment=256).collect()}
    assert db[2] - db[1] == pytest.approx(20, abs=1e-6) and db[1] - db[3] > 20
    assert signal.lag_correlation(fast, np.roll(fast, 3), 8)[1] == pytest.approx(-3, abs=0.1)


def test_event_windows_are_merged_over_traces(spark):
    rate, traces, events = 10.0, [], [(1, 3_000_000), (2, 2 * DAY)]
    draw = random.Random(12)
    for s in ("A", "B"):
        for start in (0, 1_000_000, 2_500_000, 2 * DAY - 900_000, 2 * DAY + 300_000):
            traces.append((s, "HHZ", start, rate, [draw.random() for _ in range(10)]))
    e, w = spark.createDataFrame(events, "idx long, us long"), spark.createDataFrame(traces, waveforms.TRACE)
    got = {(r.idx, r.station): r for r in waveforms.windows(e, w, before=1_500_000, after=1_000_000).collect()}
    assert len(got) == 4
    for (idx, station), r in got.items():
        start = dict(events)[idx] - 1_500_000
        out, taken = [0.0] * 25, [False] * 25
        for s, _, us, _, data in sorted(traces, key=lambda x: x[2]):
            for k, v in enumerate(data):
                at = round((us - start) * rate / 1e6) + k
                if s == station and 0 <= at < 25 and not taken[at]:
                    out[at], taken[at] = v, True
        assert r.us == start and list(r.data) == pytest.approx(out) and r.gaps == pytest.approx(1 - sum(taken) / 25)


def test_traces_from_files_and_from_the_data_source(spark, tmp_path):
    lines = "KG.A HHZ 0 10.0 1 2 3\nKG.A HHZ 86400000000 10.0 4 5\n\nbad\nKG.B HHZ 5 10.0"
    (tmp_path / "t.txt").write_text(lines)
    rows = sorted(map(tuple, waveforms.read_traces(spark, str(tmp_path)).collect()))
    assert rows == [("KG.A", "HHZ", 0, 10.0, [1.0, 2.0, 3.0]), ("KG.A", "HHZ", DAY, 10.0, [4.0, 5.0]), ("KG.B", "HHZ", 5, 10.0, [])]
    spark.dataSource.register(waveforms.TraceLines)
    source = spark.read.format("trace_lines").option("lines", lines).option("partition", 2).load()
    assert sorted(map(tuple, source.collect())) == rows
    assert [r.us for r in source.filter("us >= 5 AND us < 100").collect()] == [5]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("trace_lines").option("lines", lines).option("pushdown", "true").load()
    assert [r.us for r in pushed.filter("us >= 5 AND us < 100 AND station <> 'x'").collect()] == [5]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_event_store_by_shards(spark, tmp_path):
    store = spark.createDataFrame([(i, f"S{k}", 1.0) for i in range(20) for k in range(2)], "idx long, station string, km double")
    for i in range(3):
        waveforms.write_store(store, str(tmp_path / "s"), shard=(i, 3))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s" / "*")).select("idx", "station", "km").collect())) == sorted(map(tuple, store.collect()))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        waveforms.write_store(store, str(tmp_path / "s"), shard=(0, 3))


def test_location_and_damping(spark):
    sta = {"a": (0, 0), "b": (40, 0), "c": (0, 40), "d": (40, 40), "e": (20, 10)}
    rows = [(1, 5_000_000 + round(math.dist((12, 25, 8), (*p, 0)) / v * 1e6), phase, float(p[0]), float(p[1])) for p in sta.values() for phase, v in (("P", 6.0), ("S", 3.5))]
    rows += [(2, 0, "P", 0.0, 0.0)]
    got = detect.locate(spark.createDataFrame(rows, "event_idx long, us long, phase string, sx double, sy double"), detect.grid_locator(speed={"P": 6.0, "S": 3.5}, box=((0, 40), (0, 40), (0, 20)), rounds=8)).collect()
    assert len(got) == 1 and (got[0].x, got[0].y, got[0].z) == (pytest.approx(12, abs=0.1), pytest.approx(25, abs=0.1), pytest.approx(8, abs=0.3)) and abs(got[0].us - 5_000_000) < 50_000
    tried = []

    def solve(damping):
        tried.append(damping)
        return 4000 / damping, None

    damping, condition, _ = detect.damped(solve, first=10.0, band=(50, 60))
    assert 50 <= condition <= 60 and len(tried) <= 8 and damping == tried[-1]


def test_functions_of_the_sql_surface(spark):
    udf.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM item_pairs(array('b', 'a', 'c', 'a'))").collect()] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert spark.sql("SELECT theil_slope(x, y) AS s FROM VALUES (0.0D, 1.0D), (1.0D, 3.0D), (2.0D, 5.0D), (3.0D, 90.0D) t(x, y)").first().s == pytest.approx(16.0, abs=30)


def test_catalog_ids_epochs_coverage_covariances_and_cache(spark, tmp_path):
    (tmp_path / "c.csv").write_text("time,lat,lon\n2020-01-01T00:00:01Z,35,128\n2020-01-01T00:00:01.5Z,36,129\n,1,2\n2020-01-02T00:00:00Z,34,127\n")
    got = {r.event_key: r.latitude for r in tables.read_catalog(spark, str(tmp_path / "c.csv")).select("event_key", "latitude").collect()}
    assert got == {"20200101000001": 35, "20200101000001b": 36, "20200102000000": 34}
    (tmp_path / "e.csv").write_text("code,latitude,longitude,elevation,start,end\nN001,1,2,3,2010-01-01,2030-01-01\nN001,1,2,3,2015-01-01,2030-01-01\nN002,4,5,6,2012-01-01,\n")
    rows = {r.epoch_code: (r.net, str(r.t1)[:4]) for r in tables.read_epochs(spark, str(tmp_path / "e.csv"), net="NS").collect()}
    assert rows == {"N001a": ("NS", "2015"), "N001b": ("NS", "2030"), "N002": ("NS", "None")}
    files = spark.createDataFrame([(f"/x/S1/HHZ.D/KG.S1..HHZ.D.2020.{d:03d}",) for d in (1, 2, 2, 9, 40)] + [("/x/S1/HHN.D/KG.S1..HHN.D.2020.003",), ("junk",)], "path string")
    assert [tuple(r) for r in tables.coverage(files, year=2020, first=1, last=10).collect()] == [("S1", "HH", 4, 0.4)]
    text = [(0, "EVENT 7"), (1, " COVARIANCE"), (2, "   1.000  -2.5001234.567"), (3, "-999.999********   3.000"), (4, "   0.100   0.200   0.300"), (5, "other")]
    c = records.read_covariances(spark.createDataFrame([("f", n, v) for n, v in text], "path string, n long, value string")).first()
    assert (c.c11, c.c12, c.c13, c.c21, c.c22, c.c33) == (1.0, -2.5, 1234.567, -999.999, None, 0.3)
    loads = []
    cached = tables.Cached(lambda k: loads.append(k) or spark.range(k), most=2)
    assert [cached(k).count() for k in (1, 2, 1, 3, 1, 2)] == [1, 2, 1, 3, 1, 2] and loads == [1, 2, 3, 2]
    lines = records.read_lines(spark, str(tmp_path / "e.csv")).orderBy("n").collect()
    assert [r.value for r in lines][0].startswith("code") and len(lines) == 4


STATIONS = {"KG.A": (35.0, 128.0), "KG.B": (35.3, 128.0), "KG.C": (35.0, 128.4), "KG.D": (35.3, 128.4), "KG.E": (35.15, 128.2), "KG.F": (35.4, 128.2)}


def write_year(folder, offsets=()):
    """Two events a day seen by all stations, and picks of an unlisted one."""
    lat0, lon0 = (sum(p[i] for p in STATIONS.values()) / 6 for i in (0, 1))
    east = 111.32 * math.cos(math.radians(lat0))
    truth = []
    for day in (1, 2):
        rows = []
        for n, (x, y) in enumerate(((-5.0, 5.0), (10.0, -8.0))):
            t0 = f"2020-01-0{day}T0{n + 1}:00:"
            truth.append((day, n))
            for s, (lat, lon) in STATIONS.items():
                d = math.dist((x, y), ((lon - lon0) * east, (lat - lat0) * 110.574))
                rows += [(s, ph, f"{t0}{10 + d / v:09.6f}Z", 0.9) for ph, v in (("P", 6.0), ("S", 3.5))]
        rows.append(("XX.Z", "P", f"2020-01-0{day}T05:00:00Z", 0.9))
        (folder / f"picks_2020.{day:03d}.csv").write_text("station,phase,peak_time,probability\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    (folder / "stations.csv").write_text("Network,Code,Latitude,Longitude,Elevation\n" + "\n".join(f"{s.split('.')[0]},{s.split('.')[1]},{a},{b},10" for s, (a, b) in STATIONS.items()) + "\n")
    return truth


def test_commands_from_picks_to_a_checked_catalog(spark, tmp_path, capsys):
    truth = write_year(tmp_path)
    base = ["--picks", str(tmp_path), "--out", str(tmp_path), "--stations", str(tmp_path / "stations.csv")]
    assert cli.main(["pipeline", "--years", "2020-2021", *base, "--stage-from", "associate"]) == 1  # 2021 has no files
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert told[0]["associate"]["events"] == len(truth) and told[0]["associate"]["unlisted"] == 2 and told[0]["associate"]["assigned"] == 48
    assert told[0]["augment"]["status"] == "done" and told[0]["augment"]["before"] == 48 and told[0]["ready"]["status"] == "READY" and "failed" in told[1]
    events, assigned = tables.read_year(spark, str(tmp_path), 2020)
    a = {r.pick_idx: r for r in assigned.collect()}
    lost = sorted(a)[:5]
    kept = assigned.filter(~F.col("pick_idx").isin(lost)).select("event_idx", "pick_idx", "residual", F.concat("station", F.lit(".")).alias("station"), "phase", "time")
    tables.replace_csv(kept, str(tmp_path / "assignments_2020.csv"))
    did = commands.augment_year(spark, str(tmp_path), str(tmp_path), str(tmp_path / "stations.csv"), 2020, tolerance_s=3.0)
    assert did["before"] == 43 and did["added"] >= 1 and did["backup"]
    assert tables.read_year(spark, str(tmp_path), 2020)[1].count() == 43 + did["added"]
    assert commands.augment_year(spark, str(tmp_path), str(tmp_path), str(tmp_path / "stations.csv"), 2019) == {"year": 2019, "status": "missing"}
    assert commands.readiness(spark, str(tmp_path), str(tmp_path), 2019)["status"].startswith("incomplete")
    good = events.select("time", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).collect()
    rows = [f"{r.time.isoformat()}Z,{r.lat},{r.lon}" for r in good] + [f"{good[0].time.isoformat()}Z,36.9,131.0"]
    (tmp_path / "cat.csv").write_text("time,lat,lon\n" + "\n".join(rows) + "\n")
    outs = [x for k in ("scored", "clean", "audit") for x in (f"--out-{k}", str(tmp_path / k))]
    assert cli.main(["coherence", "--catalog", str(tmp_path / "cat.csv"), "--picks", str(tmp_path), "--stations", str(tmp_path / "stations.csv"), "--years", "2020", *outs]) == 0
    told = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1])
    scored = spark.read.option("header", True).csv(str(tmp_path / "scored"))
    assert told["events"] == 5 == scored.count() and told["testable"] == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "clean")).count() == 5 - told["flagged"]
    assert all(float(r.mv_rho) > 0.9 for r in scored.collect() if float(r.lat) < 36)


def test_detection_command_skips_days_that_are_there(spark, tmp_path):
    draw = np.random.default_rng(13)
    rows = []
    for day in (0, 1):
        x = draw.normal(0, 1, 600)
        x[300:360] += 40 * np.sin(np.arange(60))
        rows.append(f"KG.A HHZ {1577836800_000000 + day * DAY} 10.0 " + " ".join(f"{v:.3f}" for v in x))
    (tmp_path / "t.txt").write_text("\n".join(rows))
    did = commands.detect_year(spark, str(tmp_path / "t.txt"), str(tmp_path / "p"), 2020, picker=detect.energy_ratio(on=20.0))
    assert did["days"] == {1: 1, 2: 1}
    picks = tables.read_picks(spark, str(tmp_path / "p"), 2020).collect()
    assert len(picks) == 2 and all(r.phase == "P" and abs(r.peak_time.second + r.peak_time.microsecond / 1e6 - 30) < 1 for r in picks)
    assert commands.detect_year(spark, str(tmp_path / "t.txt"), str(tmp_path / "p"), 2020)["days"] == {}


def test_relocation_goes_on_where_it_stopped(spark, tmp_path):
    import pandas as pd

    frame = spark.createDataFrame([(f, float(i)) for f, n in ((1, 5), (2, 3), (3, 4)) for i in range(n)], "family long, x double")

    def solver(own):
        return pd.DataFrame({"family": own["family"].head(1), "mean": [own["x"].mean()]})

    run = lambda **k: sorted(r.family for r in commands.relocate_batch(spark, frame, solver, "family long, mean double", str(tmp_path / "m"), **k).collect())
    assert run(limit=2) == [1, 3] and run() == [2] and run() == [] and run(redo=True) == [1, 2, 3]


def test_classes_and_omori_by_hand(spark):
    rows = [("swarm", i, 2.0, float(i)) for i in range(10)] + [("main", i, 5.0 if i == 1 else 2.0, float(i)) for i in range(10)] + [("fore", i, 5.0 if i == 5 else 2.0, float(i)) for i in range(10)]
    frame = spark.createDataFrame(rows, "k string, id long, m double, t double")
    got = {r.k: r.kind for r in stats.family_class(frame, keys=["k"], magnitude="m", at="t", id="id").collect()}
    assert got == {"swarm": "swarm", "main": "mainshock_aftershock", "fore": "foreshock_mainshock_aftershock"}
    t = [0.01 * (1 + 0.05) ** k for k in range(200)]  # equal numbers in equal log times: p = 1
    days = spark.createDataFrame([("o", 0, 6.0, 10.0)] + [("o", i + 1, 2.0, 10.0 + v) for i, v in enumerate(t)], "k string, id long, m double, d double")
    r = stats.omori(days, keys=["k"], magnitude="m", days="d", id="id").first()
    assert r.n == 200 and r.p == pytest.approx(1.0, abs=0.05)
    few = stats.omori(days.limit(5), keys=["k"], magnitude="m", days="d", id="id")
    assert few.count() == 0


def test_families_of_any_shape(spark):
    draw = random.Random(14)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    up = {i: i for i in range(300)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = graph.connected(spark.createDataFrame(edges, "a long, b long"), spark.range(300), a="a", b="b", id="id")
    assert {r.id: r.family for r in got.collect()} == {i: root(i) for i in range(300)}


def test_numbers_of_a_query_without_sql(spark):
    """The registered queries that SQL does not express, held against plain code on the small tables."""
    run = lambda name: queries.queries()[name](spark, SF)
    keys = sorted(r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
    points = np.array([[(128 + k % 997 / 997.0 - 128) * 91, (35 + k * 7 % 991 / 991.0 - 35) * 111, k * 13 % 211 / 10.0] for k in keys])
    tree = {r.idx: r.cluster for r in run("c10_density_tree").collect()}
    assert tree == dict(zip(keys, cluster_tree.density_tree_labels(points, 30, 30).tolist(), strict=True))
    located = run("c18_located").collect()
    truth = {r.o_orderkey: ((r.o_orderkey % 997) / 997 * 50, (r.o_orderkey * 7 % 991) / 991 * 50) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    assert len(located) == len(truth) and np.median([math.dist((r.x, r.y), truth[r.event_idx]) for r in located]) < 0.5
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert run("str05_once").count() == e.count()


def test_permutations_do_not_go_with_the_counts(spark):
    cells = lambda k: spark.createDataFrame([(z, b, k * (n + 3 * b)) for z, n in zip("abc", (40, 41, 39), strict=True) for b in range(7)], "z string, b int, n long")
    small, large = (rates.permutation_null(cells(k), zone="z", bin="b", count="n", times=199).first() for k in (1, 900_000))  # 926 million events
    assert large.distance == pytest.approx(small.distance) and small.p > 0.5 and large.p == pytest.approx(1 / 200)
    draw = np.random.default_rng(0)
    totals, sizes = np.array([5, 3, 2]), (4, 6)
    bins = np.array([0] * 5 + [1] * 3 + [2] * 2)
    mixed = [np.bincount(draw.permutation(bins)[: sizes[0]], minlength=3)[0] for _ in range(4000)]
    drawn = [draw.multivariate_hypergeometric(totals, sizes[0], method="marginals")[0] for _ in range(4000)]
    assert np.bincount(mixed, minlength=5) / 4000 == pytest.approx(np.bincount(drawn, minlength=5) / 4000, abs=0.04)
