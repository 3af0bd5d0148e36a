"""Operators 11 to 13 against brute force, with hard cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from catalogflow.llm import pivot_dedup, prefix_trie, queries, whitening

from ..conftest import SF
from .cases import words

TURNS = "conv_id long, turn long, role string, text string, depth long, salt int, part string, n long"


def turn_key(t):
    role, text = t[2] or "", t[3] or ""
    half = hashlib.sha256((str(len(role)) + ":" + role + text).encode()).hexdigest()
    return (t[1] is not None, t[1] or 0, role, int(half[:15], 16), int(half[15:30], 16))


def trie(rows):
    """The contract, by prefixes as tuples."""
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {n: sum(len(x) == len(n) + 1 and x[:-1] == n for x in members) for n in members}
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * (len(words(x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(children[x] == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, rows):
    more = [(*r, 7, None, "x", 3) for r in rows]
    return spark.createDataFrame(more, TURNS).repartition(3)


def found_trie(spark, rows):
    return sorted(map(tuple, prefix_trie.conversation_trie(talks(spark, rows)).collect()), key=str)


def hard_talks():
    rows = []
    for c in (0, 1, 2, 3, 5, 19, 20, 21, 40, 45, 61, 65, -3, -20, 10**12 + 7):  # 60 and 10**12 are not there
        for t in range((c % 5) + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of\x0bfamily {c // 20} {'long ' * (c % 3)}"))
    rows += [(41, None, None, None), (41, 2, "user", ""), (41, 2, "user", ""), (41, 2, None, "b a"), (41, 1, "x", None), (None, 1, "user", "gone"), (42, 5, "é日", " \t\n")]
    rows += [(c, t, "user", "the same first words") for c in range(100, 140) for t in range(3)]  # copies, and members without a turn
    return rows


def test_trie_equals_brute_force(spark):
    rows = hard_talks()
    assert found_trie(spark, rows) == trie(rows)


def test_trie_of_nothing_and_of_one_turn(spark):
    assert found_trie(spark, []) == []
    for c in (60, 61, 62, 63, 64):  # with every number of shared turns; where the family's first is absent, without turns
        rows = [(c, 0, "user", "one two")]
        assert found_trie(spark, rows) == trie(rows)


def test_trie_of_long_and_of_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BUCKET", 4)
    monkeypatch.setattr(prefix_trie, "SALTS", 3)
    draw = random.Random(4)
    rows = [(c, t, "user", f"w{draw.randrange(2)} " * draw.randrange(3)) for c in range(20, 60) for t in range(draw.randrange(1, 6))]
    rows += [(7, t // 3, "user", f"step {t}") for t in range(90)] + [(8, t, "user", f"step {t}") for t in range(40)] + [(9, 0, "user", "again")] * 50
    rows += [(c, t, "user", "hot") for c in range(1000, 1300) for t in range(6)]
    assert found_trie(spark, rows) == trie(rows)


def whitened(vectors, k=4):
    """By numpy and Python's integers."""
    width = max((len(v) for _, v in vectors), default=0)
    codes = [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (width - len(v))) for i, v in vectors]
    fit = sorted({x for _, x in codes})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[x - s / n for x, s in zip(row, sums, strict=True)] for row in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    kept = min(k, int((e > 1e-13 * e[0]).sum()))
    out = []
    for i, x in codes:
        away = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        w = (np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ u[:, :kept]) / np.sqrt(e[:kept])
        out += [(i, j + 1, n, away, w[j], e[j] / np.trace(cov)) for j in range(kept)]
    return out


def same_whitening(got, want):
    got = sorted(got, key=lambda r: (r.vec_id, r.component, r.deviation))
    want = sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    for c in {r.component for r in got}:
        a, b = np.array([r.whitened for r in got if r.component == c]), np.array([r[4] for r in want if r[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert all(abs(r.explained / w[5] - 1) < 1e-6 for r, w in zip(got, want, strict=True))
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-6 for r in got)


def test_whitening_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(queries.op12_whitening(spark, SF).collect(), whitened(rows))


def vectors(spark, rows, kind="double"):
    more = [(i, v, 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(more, f"vec_id long, embedding array<{kind}>, n int, code string, component int").repartition(3)


def test_whitening_of_hard_rows(spark):
    draw = np.random.default_rng(3)
    sound = [(i, draw.normal(size=6).tolist()) for i in range(40)]
    sound += [(1, sound[1][1]), (90, sound[2][1]), (91, [1.0, 2.0]), (92, [])]  # copies, a repeated id, short ones
    sound += [(93, [5e3] + [0.0] * 5), (94, [-0.0] * 6)]
    odd = [(80, None), (81, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (82, [float("nan")] * 6), (83, [float("inf")] * 6), (84, [1e300] * 6)]
    same_whitening(whitening.whiten(vectors(spark, sound + odd)).collect(), whitened(sound))


def test_whitening_beyond_64_bits_and_without_variance(spark):
    far = [(i, [float(i * i), 1e14 * (i % 3), 0.0]) for i in range(9)]
    got, want = whitening.whiten(vectors(spark, far)).collect(), whitened(far, 2)
    assert {r.component for r in got} == {1} and {r.deviation for r in got if r.vec_id % 3 == 0} == {None}  # the other two have no share in the variance
    assert all(r.deviation is None or (r.vec_id, r.component, r.deviation) in {(a, b, d) for a, b, _, d, *_ in want} for r in got)
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_exact_sums_beyond_64_bits():
    x = np.array([[2**62, -(2**62)], [3, 5]], np.int64)
    assert whitening.deviations(x, 10**6, [7, -9]) == [sum((10**6 * int(c) - s) ** 2 for c, s in zip(row, (7, -9), strict=True)) for row in x]
    for value in (0, -1, 2**61, -(2**200) + 5, 2**200 + 3):
        assert sum(v << (62 * p) for p, v in whitening._limbs(value)) == value


def links_of(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    sound = [v is not None and label is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    width = max((len(v) for _, v, _ in rows if v is not None), default=1)
    unit = [np.array([*v, *[0.0] * (width - len(v))]) / max(map(abs, v)) if ok else None for (_, v, _), ok in zip(rows, sound, strict=True)]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    of = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            of[root(i)] = min(of.get(root(i), r[0]), r[0])
    return sorted(((r[0], n[i], of.get(root(i)) if r[0] is not None else None, r[0] is None or r[0] == of[root(i)]) for i, r in enumerate(rows)), key=str)


def labelled(spark, rows):
    more = [(i, v, label, 1, "x", 2) for i, v, label in rows]
    return spark.createDataFrame(more, "vec_id long, embedding array<double>, label int, node int, unit string, links int").repartition(3)


def near_group(draw, count, dims, noise, around=None):
    around = draw.normal(size=dims) if around is None else around
    return [(around + noise * np.linalg.norm(around) / math.sqrt(dims) * draw.normal(size=dims)).tolist() for _ in range(count)]


@pytest.mark.parametrize(("dims", "noise", "block"), [(64, 0.1, 2048), (64, 0.14, 7), (3, 0.15, 16), (1, 0.3, 8)])
def test_pivots_equal_all_pairs(spark, dims, noise, block):
    draw = np.random.default_rng(dims)
    found = [v for _ in range(4) for v in near_group(draw, 25, dims, noise)] + near_group(draw, 60, dims, 2.0)
    rows = [(i, v, i % 2) for i, v in enumerate(found)]
    got = sorted(map(tuple, pivot_dedup.near_vectors(labelled(spark, rows), pivots=64, block=block).collect()), key=str)
    want = links_of(rows)
    recall = sum(g[1] for g in got) / max(1, sum(w[1] for w in want))
    assert sum(w[1] for w in want) > 100 and recall >= 0.97 and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert got == want or recall < 1


def test_pivots_on_hard_rows(spark):
    a, b = [1.0, 0.0, 2.0], [0.0, 3.0, 1.0]
    rows = [(1, a, 5), (2, a, 5), (3, [2.0, 0.0, 4.0], 5), (4, a, 6), (5, a, None), (6, None, 5), (7, [], 5), (8, [0.0] * 3, 5), (9, [float("nan"), 1.0, 1.0], 5), (10, [1.0, None, 2.0], 5)]
    rows += [(11, [float("inf"), 0.0, 1.0], 5), (12, [*a, 0.0, 0.0], 5), (13, [1e300, 0.0, 2e300], 5), (14, [1e-300, 0.0, 2e-300], 5), (2, b, 5), (20, b, 5), (2, b, 5), (None, b, 5), (None, None, 5), (15, [1.0, 0.1, 2.0], 5)]
    got = sorted(map(tuple, pivot_dedup.near_vectors(labelled(spark, rows)).collect()), key=str)
    assert got == links_of(rows)
    assert pivot_dedup.near_vectors(labelled(spark, [])).collect() == []
    alone = pivot_dedup.near_vectors(labelled(spark, [(3, a, None), (4, None, 1)])).collect()
    assert sorted(map(tuple, alone)) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_a_pair_meets_in_one_list():
    draw = np.random.default_rng(8)
    near = np.argsort(draw.random((40, 12)), axis=1)[:, :6]
    for shared in (1, 2, 3, 5, 6):
        who, first, second = pivot_dedup.posted(near, shared)
        lists = {}
        for row, p, q in zip(who.tolist(), first.tolist(), second.tolist(), strict=True):
            lists.setdefault((p, q), []).append(row)
        met = np.zeros((40, 40), int)
        for (p, q), rows in lists.items():
            met[np.ix_(rows, rows)] += pivot_dedup.candidates(near[rows], near[rows], p, q, shared, 12)
        common = (near[:, :, None, None] == near.T[None, None, :, :]).any(axis=2).sum(axis=1)
        assert (met == (common >= shared)).all()


def test_registered_pivots_reach_every_link(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_pivot_dedup(spark, SF).collect()), key=str) == links_of(rows)
