"""Normals of points by their nearest against a plain version over all distances, in a plan without a task for each structure."""

from __future__ import annotations

import numpy as np

from bagweave.operators import structures


def test_normals(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, (160, 3)), r.normal(5, 0.2, (30, 3)), r.normal(0, 1, (10, 3))])
    owner = [("a", "b")[i % 2] if i < 190 else None for i in range(199)] + ["one"]
    rows = [(owner[i], i, *map(float, p)) for i, p in enumerate(x)]
    df = structures.surface_normals(spark.createDataFrame(rows, "owner string, atom long, x double, y double, z double").repartition(3), "owner", 8)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    got = {g["atom"]: [g["nx"], g["ny"], g["nz"]] for g in df.collect()}
    assert len(got) == len(rows) and got.pop(199) == [None] * 3
    for i, n in got.items():
        own = [j for j in range(len(x)) if owner[j] == owner[i]]
        near = x[sorted(own, key=lambda j: (((x[j] - x[i]) ** 2).sum(), j))[:9]]
        want = np.linalg.eigh(np.cov((near - near.mean(0)).T))[1][:, 0]
        assert np.allclose(n, want if (x[i] - x[own].mean(0)) @ want >= 0 else -want)
