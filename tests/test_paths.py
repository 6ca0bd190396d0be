"""Paths of four atoms: the same rows as from joined edges, and none of them written or dealt out."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from bagweave.operators import structures


def test_dihedrals_deal_out_atoms_only(spark):
    r = random.Random(7)
    x = {5 * i: tuple(round(r.uniform(-1, 1), 3) for _ in range(3)) for i in range(40)}
    x |= {900: x[0], 901: (9.0, 9.0, 9.0), 902: (9.0, 9.0, 9.4)}  # one place twice, and a pair alone
    beside = {i: [j for j in x if j != i and sum((a - b) * (a - b) for a, b in zip(x[i], x[j], strict=True)) <= 0.6 * 0.6] for i in x}
    sub = lambda a, b: [p - q for p, q in zip(x[b], x[a], strict=True)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    want = {}
    for j in x:
        for k in beside[j]:
            for i in beside[j]:
                for m in beside[k]:
                    if i != k and m != j and i < m:
                        u, v, w = sub(i, j), sub(j, k), sub(k, m)
                        a, b = cross(u, v), cross(v, w)
                        want[i, j, k, m] = round(math.atan2(math.sqrt(dot(v, v)) * dot(u, b), dot(a, b)), 5)
    rows = spark.createDataFrame([(i, *p) for i, p in x.items()] + [(903, None, 0.0, 0.0)], "atom long, x double, y double, z double")
    df = structures.dihedrals(rows, "atom", 0.6, 5)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(want) > 400
    assert all(abs(want[i, j, k, m] - t) < 1.5e-5 for i, j, k, m, t in got) and sum(want[i, j, k, m] != t for i, j, k, m, t in got) < 3


def test_rounding_half_up():
    values = np.array([1.000005, 1.000015, -1.000005, 0.0, -0.0, -1e-9, 3.141592653589793, 2.5e-6, 5e-6, *np.random.default_rng(1).uniform(-4, 4, 500)])
    want = [float(Decimal(repr(float(v))).quantize(Decimal("0.00001"), ROUND_HALF_UP)) + 0.0 for v in values]
    assert structures.half_up(values, 5).tolist() == want and not np.signbit(structures.half_up(np.array([-1e-9, -0.0]), 5)).any()
