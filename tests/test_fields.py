"""Operators without SQL against plain versions, and gates that must fail."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagweave.operators import fields
from bagweave.sources import arrays


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            cost = r.integers(-9, 9, (n, n)).astype(float)
            got = fields.assignment(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_representatives(spark):
    """A line of seven points and a ring: farthest points along the edges, and masses by nearest one, ties to the lower point."""
    points = [("line", i, float(i + 1)) for i in range(7)] + [("ring", 10 + i, 1.0) for i in range(6)]
    edges = [("line", i, i + 1, 1.0 + (i == 5)) for i in range(6)] + [("ring", 10 + i, 10 + (i + 1) % 6, 1.0) for i in range(6)]
    got = fields.representatives(spark.createDataFrame(points, "r string, point long, mass double"), spark.createDataFrame(edges, "r string, a long, b long, w double"), "r", 3).collect()
    assert {(x["r"], x["place"]): (x["point"], x["mass"]) for x in got} == {("line", 1): (0, 3.0), ("line", 2): (6, 7.0), ("line", 3): (3, 18.0), ("ring", 1): (10, 2.0), ("ring", 2): (13, 2.0), ("ring", 3): (11, 2.0)}
    with pytest.raises(Exception, match="not connected"):
        fields.representatives(spark.createDataFrame([("x", 1, 1.0), ("x", 2, 1.0)], "r string, point long, mass double"), spark.createDataFrame([], "r string, a long, b long, w double"), "r", 2).collect()


def test_free_paths(spark):
    """Distances from the border in boxes with walls, against relaxation until nothing changes."""
    r = random.Random(4)
    rows = [(o, x, y, z, r.random() < 0.45) for o in range(3) for x in range(6) for y in range(5) for z in range(5)]
    got = {tuple(x)[:4]: x["distance"] for x in fields.free_paths(spark.createDataFrame(rows, "o long, cx long, cy long, cz long, filled boolean"), "o", 0.5).collect()}
    for o in range(3):
        free = {(x, y, z) for k, x, y, z, f in rows if k == o and not f}
        d = {c: 0.0 if c[0] in (0, 5) or c[1] in (0, 4) or c[2] in (0, 4) else math.inf for c in free}
        changed = True
        while changed:
            changed = False
            for c in free:
                for s in itertools.product((-1, 0, 1), repeat=3):
                    n = tuple(a + b for a, b in zip(c, s, strict=True))
                    if any(s) and n in free and d[n] + 0.5 * math.sqrt(sum(map(abs, s))) < d[c] - 1e-12:
                        d[c], changed = d[n] + 0.5 * math.sqrt(sum(map(abs, s))), True
        for k, x, y, z, f in rows:
            if k == o:
                want = None if f or math.isinf(d[x, y, z]) else d[x, y, z]
                assert got[o, x, y, z] == (want if want is None else pytest.approx(want))


def test_curvatures_of_a_sphere(spark):
    rng = np.random.default_rng(5)
    n = rng.standard_normal((900, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    rows = [(0, i, *map(float, 2 * v), *map(float, v)) for i, v in enumerate(n)]
    got = fields.curvatures(spark.createDataFrame(rows, "o long, p long, x double, y double, z double, nx double, ny double, nz double"), "o", "p", 12).toPandas()
    assert np.abs(got["mean"].median() + 0.5) < 0.02 and np.abs(got["gaussian"].median() - 0.25) < 0.02 and np.abs(got["curvedness"].median() - 0.5) < 0.03


def test_gates_fail(spark, tmp_path):
    df = spark.createDataFrame([("3.0", 1), ("2.0", 2)], "schema_version string, a int")
    with pytest.raises(ValueError, match="missing"):
        arrays.array_table(df, "3.0", ["b"], {}, {"f": ["a"]}, ["f"])
    with pytest.raises(Exception, match="schema version 2.0"):
        arrays.array_table(df, "3.0", ["a"], {}, {"f": ["a"]}, ["f"]).collect()
    members = spark.createDataFrame([(1, "train", ["half"], "a"), (2, "train", ["half"], "b")], "id int, split string, views array<string>, task string")
    with pytest.raises(ValueError, match="2 tasks"):
        arrays.managed_index(members, "train", "half")
    with pytest.raises(ValueError, match="header"):
        arrays.legacy_manifest(df, "id;label")
    with pytest.raises(ValueError, match="1 items of 5"):
        arrays.staged_pages(spark.createDataFrame([(5, '[{"id": 1}]')], "total int, items string"), "total", "items", "struct<id: int>")
    path = f"file://{tmp_path}/out"
    assert arrays.validated_write(df, path)[0] == 2 and arrays.validated_write(df.limit(1), path)[0] == 1
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "out.writing").exists()


def test_receipts_of_broken_documents(spark):
    rows = arrays.receipts(spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": '), (3, None)], "i int, d string"), "i", "d", {"k": "int"}).orderBy("i").collect()
    assert [(x["k"], x["parsed"]) for x in rows] == [(3, True), (None, False), (None, False)] and rows[0]["bytes"] == 8


def test_edges_of_flags(spark):
    edges = spark.createDataFrame([(1, 2, 0, 1.0, 1), (1, 3, 2, 1.0, 0), (2, 3, 0, 9.0, 8), (1, 9, 1, 1.0, 1)], "a long, b long, rank int, distance double, relation int")
    valid = spark.createDataFrame([(1,), (2,), (3,)], "residue long")
    pick = lambda mode: sorted((x["a"], x["b"]) for x in fields.active_residue_edges(edges, valid, mode, 3, 6.0).collect())
    assert pick("sequence") == [(1, 2), (2, 3)] and pick("contact") == [(1, 3)] and pick("all") == [(1, 2), (1, 3), (2, 3)]
    assert fields.active_atom_edges(edges.withColumn("covalent", F.col("relation") == 8), 1).count() == 2
