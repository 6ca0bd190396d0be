"""Quantiles, rank correlation and overlaps of few large groups, without windows over a group or buffers of its values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bagweave.functions.ranged import exact_quantiles
from bagweave.operators import bags, evaluation


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(g, i, r.randrange(9) / 4, r.gauss(0, 1) if g else float(r.randrange(5)), float(r.randrange(1, 9)), r.random() < 0.7, r.random()) for i, g in enumerate([0] * 80 + [1] * 61 + [2] * 1 + [3] * 7)]
    return spark.createDataFrame(data, "g int, point long, a double, b double, area double, valid boolean, second_p double").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles(rows):
    shares = {"low": 0.25, "mid": 0.5, "high": 0.75}
    want = rows.groupBy("g").agg(*(F.percentile("b", F.lit(v)).alias(k) for k, v in shares.items())).collect()
    got = exact_quantiles(rows, ["g"], "b", shares)
    assert "percentile" not in plan(got)
    assert {r["g"]: pytest.approx(tuple(r)) for r in got.collect()} == {r["g"]: tuple(r) for r in want}
    whole = exact_quantiles(rows, [], "b", {"q": 0.9}).first()["q"]
    assert whole == pytest.approx(rows.agg(F.percentile("b", F.lit(0.9))).first()[0])


def test_rank_correlation_and_overlaps(rows):
    got = evaluation.map_comparison(rows, ["g"], "a", "b", "area", "valid")
    assert "windowspecdefinition(g#" not in plan(got)
    assert "windowspecdefinition(g#" in plan(bags.spearman(rows, ["g"], "a", "b"))
    kept = rows.filter("valid")
    rho = {r["g"]: r["rho"] for r in bags.spearman(kept, ["g"], "a", "b").collect()}
    iou = {}
    for share in (0.05, 0.1):
        both = bags.top_area(bags.top_area(kept, ["g"], "a", "area", share).withColumnRenamed("mass", "left"), ["g"], "b", "area", share)
        for r in both.groupBy("g").agg((F.sum(F.least("left", "mass")) / F.sum(F.greatest("left", "mass"))).alias("x")).collect():
            iou[r["g"], round(100 * share)] = r["x"]
    for r in got.collect():
        near = lambda x: x if x is None else pytest.approx(x)
        assert r["spearman"] == near(rho.get(r["g"]))
        assert r["top_5_iou"] == near(iou.get((r["g"], 5))) and r["top_10_iou"] == near(iou.get((r["g"], 10)))
