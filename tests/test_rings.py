"""Nearest rows by growing rings against plain versions, and how few pairs they look at."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagweave.operators import spatial, structures


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    x = np.round(np.concatenate([r.normal(0, 1.2, (420, 3)), np.zeros((40, 3)), r.normal(0, 9, (40, 3))]), 3)
    return [(7 * i % 1009, i % 3, *map(float, p), *map(float, n), 0.2 + i % 4 * 0.05) for i, (p, n) in enumerate(zip(x, r.normal(0, 1, x.shape), strict=True))]


@pytest.fixture
def atoms(spark, rows):
    return spark.createDataFrame(rows, "atom long, owner int, x double, y double, z double, nx double, ny double, nz double, radius double").repartition(3)


@pytest.fixture
def looked(monkeypatch):
    """Numbers of pairs that near_pairs gave."""
    seen, plain = [], spatial.near_pairs

    def counted(*args, **kw):
        out = plain(*args, **kw)
        seen.append(out.count())
        return out

    monkeypatch.setattr(spatial, "near_pairs", counted)
    return seen


def d(p, q):
    return math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[2:5], q[2:5], strict=True)))


@pytest.mark.parametrize("apart", [False, True])
def test_nearest(rows, atoms, looked, apart):
    keep = F.col("a_owner") != F.col("b_owner") if apart else None
    near = {p[0]: sorted((d(p, q), q[0]) for q in rows if q[0] != p[0] and d(p, q) <= 2.0 and not (apart and p[1] == q[1])) for p in rows}
    got = {(r["src"], r["rank"]): (pytest.approx(r["d"]), r["dst"]) for r in spatial.nearest(atoms, atoms, 2.0, 4, "atom", "atom", self_join=not apart, keep=keep, alike=["owner"]).collect()}
    assert got == {(i, n): x for i, all_ in near.items() for n, x in enumerate(all_[:4], 1)}
    assert sum(looked) < sum(map(len, near.values())) / 2


def test_mutual_nearest(rows, atoms):
    even, odd = ([p for p in rows if p[0] % 2 == k] for k in (0, 1))
    one = {p[0]: min(((d(p, q), q[0]) for q in odd if d(p, q) <= 1.5), default=None) for p in even}
    two = {q[0]: min(((d(p, q), p[0]) for p in even if d(p, q) <= 1.5), default=None) for q in odd}
    want = {(a, b[1]) for a, b in one.items() if b and two[b[1]][1] == a}
    got = spatial.mutual_nearest(atoms.filter("atom % 2 = 0"), atoms.filter("atom % 2 = 1"), 1.5, "atom", "atom", -1.1).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_gaps(rows, atoms, looked):
    want, all_ = {}, 0
    for p in rows:
        near = [(d(p, q), q[0], q[8]) for q in rows if q[1] != p[1] and d(p, q) <= 5.0]
        all_ += len(near)
        if near:
            want[p[0]] = (pytest.approx(min(near)[0] - min(near)[2]), pytest.approx(min(x - r for x, _, r in near)))
    got = spatial.gaps(atoms, atoms, 5.0, "atom", F.col("a_owner") != F.col("b_owner"), ["owner"]).collect()
    assert {r["atom"]: (r["nearest_gap"], r["least_gap"]) for r in got} == want
    assert sum(looked) < all_ / 2


def test_exposed_area(spark, rows, atoms, looked):
    ways = [(k, *map(float, v)) for k, v in enumerate(np.vstack([np.eye(3), -np.eye(3)]))]
    want, all_ = {}, 0
    for p in rows:
        gone = 0
        for _, *u in ways:
            spot = (0, 0, *(c + (p[8] + 1.4) * x for c, x in zip(p[2:5], u, strict=True)))
            hits = sum(q[0] != p[0] and d(spot, q) < q[8] + 1.4 - 1e-9 for q in rows)
            all_ += hits
            gone += hits > 0
        want[p[0]] = pytest.approx((1 - gone / 6) * 4 * math.pi * (p[8] + 1.4) ** 2)
    got = structures.exposed_area(atoms, spark.createDataFrame(ways, "k int, x double, y double, z double"), 1.4, 0.35, 6).collect()
    assert {r["atom"]: r["area"] for r in got} == want
    assert sum(looked) < all_ / 2
