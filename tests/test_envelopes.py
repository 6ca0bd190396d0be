"""Envelope gaps, normals and curvature identities on spheres that are known."""

from __future__ import annotations

import math

import pytest

from bagweave.operators import envelopes

POINTS = "owner string, point long, x double, y double, z double, nx double, ny double, nz double"


def test_points_of_one_sphere(spark):
    r = 1.5 + 1.4
    at = lambda i, s=1.0: (r * s * math.cos(i), r * s * math.sin(i), 0.0)
    rows = [("a", i, *at(i), math.cos(i), math.sin(i), 0.0) for i in range(6)]
    rows += [("a", 10, *at(0.5, 0.9), math.cos(0.5), math.sin(0.5), 0.0), ("a", 11, *at(0.5, 1.05), -math.cos(0.5), -math.sin(0.5), 0.0), ("a", 12, 50.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    spheres = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 1.5)], "owner string, x double, y double, z double, radius double")
    got = {(x["owner"], x["point"]): x for x in envelopes.alignment(spark.createDataFrame(rows, POINTS), spheres, "owner", "point", 1.5, 1.4, 1.0).collect()}
    assert all(abs(got["a", i]["gap"]) < 1e-9 and got["a", i]["cosine"] == pytest.approx(1) for i in range(6))
    assert got["a", 10]["gap"] == pytest.approx(-0.1 * r) and got["a", 11]["gap"] == pytest.approx(0.05 * r) and got["a", 11]["cosine"] == pytest.approx(-1)
    assert all((got[k]["gap"], got[k]["cosine"]) == (None, 0.0) for k in (("a", 12), ("b", 1)))
    report = {x["owner"]: x for x in envelopes.envelope_report(spark.createDataFrame(list(got.values())), "owner", 1.0).collect()}
    assert [report["a"][c] for c in ("points", "inside", "off", "turned")] == [9, 1, 2, 2] and report["a"]["widest_gap"] == pytest.approx(0.1 * r)
    assert report["b"]["least_gap"] is None and report["b"]["off"] == 1


def test_two_spheres_blend_where_they_meet(spark):
    spheres = spark.createDataFrame([("a", -1.0, 0.0, 0.0, 0.6), ("a", 1.0, 0.0, 0.0, 0.6), ("a", 9.0, 0.0, 0.0, 0.6)], "owner string, x double, y double, z double, radius double")
    seam = math.sqrt(2.0**2 - 1)
    point = spark.createDataFrame([("a", 1, 0.0, seam, 0.0, 0.0, 1.0, 0.0)], POINTS)
    got = envelopes.alignment(point, spheres, "owner", "point", 0.6, 1.4, 1.0).first()
    assert got["gap"] == pytest.approx(0, abs=1e-12) and got["cosine"] == pytest.approx(1)


def test_curvature_identities(spark):
    rows = [("a", 0.5, 0.25, 0.5), ("a", 0.5, 0.25, 0.6), ("a", 0.0, -1000.0, math.sqrt(1000.0)), ("b", -1.0, 1.0, 1.0)]
    got = {x["owner"]: tuple(x)[1:] for x in envelopes.curvature_faults(spark.createDataFrame(rows, "owner string, h double, k double, c double"), "owner", "h", "k", "c", 1.0).collect()}
    assert got["a"] == (1, 1, pytest.approx(math.sqrt(1000.0))) and got["b"] == (0, 0, 1.0)
