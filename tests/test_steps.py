"""Depths among near points: those of a plain search, also in blocks and at the border, and only points are dealt out."""

from __future__ import annotations

import random

import numpy as np
import pytest

from bagweave.operators import graph


@pytest.mark.parametrize(("sources", "distances", "limit"), [(70, 300, 4), (2048, 262_144, 31), (7, 300, 1)])
def test_near_depths(spark, monkeypatch, sources, distances, limit):
    monkeypatch.setattr(graph, "SOURCES", sources)
    monkeypatch.setattr(graph, "DISTANCES", distances)
    r = random.Random(5)
    x = {3 * i: tuple(round(r.gauss(0, 1.3), 3) for _ in range(3)) for i in range(250)}
    x |= {2000 + i: (40 + round(0.6 * i, 4), -50.0, 0.0) for i in range(40)}  # steps of the radius itself, as near as doubles are
    x |= {3000: x[0], 3001: (9e9, 9e9, -9e9), 3002: (9e9, 9e9, -9e9)}
    near = lambda p, q: (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]) <= 0.6 * 0.6
    beside = {i: [j for j in x if j != i and near(x[i], x[j])] for i in x}
    want = {(3003, 3003, 0), (3004, 3004, 0)}
    for source in x:
        depths, at = {source: 0}, [source]
        for depth in range(1, limit + 1):
            at = [v for u in at for v in beside[u] if v not in depths and depths.setdefault(v, depth) == depth]
        want |= {(source, v, d) for v, d in depths.items()}
    rows = [(i, *p) for i, p in x.items()] + [(3003, None, 0.0, 0.0), (3004, float("nan"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    df = graph.near_depths(spark.createDataFrame(rows, "atom long, x double, y double, z double"), "atom", 0.6, limit)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan.split("FlatMapGroups")[0]
    got = [tuple(row) for row in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_within():
    r = np.random.default_rng(2)
    a, b = np.round(r.uniform(-1, 1, (80, 3)), 1), np.round(r.uniform(-1, 1, (90, 3)), 1)
    d = a[:, None] - b
    assert (graph.within(a, b, 0.6) == (d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2 <= 0.6 * 0.6)).all()
