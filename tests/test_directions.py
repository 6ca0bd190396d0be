"""Greedy removal of like directions, and refinement without strength, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from bagweave.operators import fields, structures


@pytest.mark.parametrize(("dims", "threshold"), [(2, 0.95), (6, 0.7)])
def test_independent_directions_are_those_of_a_greedy_pass(spark, dims, threshold):
    rng = np.random.default_rng(dims)
    base = rng.normal(0, 1, (12, dims))
    x = np.concatenate([base[rng.integers(0, 12, 110)] * rng.choice([-1, 1, 3], (110, 1)) + rng.normal(0, 0.15, (110, dims)), np.zeros((2, dims))])
    score = rng.integers(0, 20, len(x))
    rows = [(int(i), p.tolist(), int(s)) for i, (p, s) in enumerate(zip(x, score, strict=True))]
    kept = []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        unit = lambda k: x[k] / max(np.linalg.norm(x[k]), 1e-12)
        if all(abs(unit(i) @ unit(k)) < threshold for k in kept):
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, v array<double>, score int").repartition(3)
    assert sorted(r["id"] for r in structures.independent_directions(df, "id", "v", "score", threshold).collect()) == sorted(kept)
    assert structures.independent_directions(df.limit(0), "id", "v", "score", threshold).count() == 0


def test_refinement_without_strength_or_steps_gives_raw_values(spark):
    values = spark.createDataFrame([(1, 40.0), (2, -3.0)], "point long, raw double")
    edges = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, w double")
    for given in ({"strength": 0.0}, {"steps": 0}):
        assert sorted(map(tuple, fields.crf_refined(values, edges, **given).collect())) == [(1, 40.0), (2, -3.0)]


def test_many_axes_are_compared_in_blocks(spark, monkeypatch):
    """No joined pairs, whatever the blocks: also sliced, and some of them empty."""
    x = np.random.default_rng(1).normal(0, 1, (300, 32))
    x[100:120] = -x[:20]
    df = spark.createDataFrame([(int(i), p.tolist()) for i, p in enumerate(x)], "id long, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.abs(u @ u.T) >= 0.45), strict=True) if i < j}
    got = structures.similar_directions(df, "id", "v", 0.45)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
    monkeypatch.setattr(structures, "BLOCK", 20)
    monkeypatch.setattr(structures, "SLICE", 50)
    assert {tuple(r) for r in structures.similar_directions(df, "id", "v", 0.45).collect()} == want
    assert {tuple(r) for r in structures.similar_directions(df.limit(3), "id", "v", 0.45).collect()} <= want
