"""Loops of joins and tasks that are long for their bytes: what a larger table would make of them."""

import numpy as np
from catalogflow.operators import graph
from catalogflow.plans import queries as core


def estimated(frame):
    return frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_rounds_do_not_let_a_plans_estimated_size_grow(spark):
    core.prepare(spark)
    n = 600
    names = np.random.default_rng(1).permutation(n).tolist()
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    links = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:], strict=False) if a % 200], "a long, b long")
    found = graph.connected(links, nodes, a="a", b="b", id="id")
    assert estimated(found) < 1 << 60
    assert {r.family for r in found.collect()} >= {0} and found.count() == n
    chain = spark.createDataFrame([(i, i - 1 if i % 200 else None) for i in range(n)], "id long, parent long")
    told = graph.depths(chain, id="id", parent="parent")
    assert estimated(told) < 1 << 60
    assert {r.id: (r.root, r.depth) for r in told.collect()} == {i: (i - i % 200, i % 200) for i in range(n)}
