"""Many small bags: as many tasks as the session has partitions, and one shuffle for a comparison of owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagweave.operators import assets, bags


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bags_are_dealt_over_all_partitions(spark):
    rows = spark.range(300).selectExpr("id % 40 as owner", "id as point", "id % 7 / 7.0D as p", "id % 5 / 5.0D as q", "1.0D + id % 3 as area")
    for df in (bags.spearman(rows, ["owner"], "p", "q"), bags.pooled(rows, ["owner"])):
        assert "REPARTITION_BY_NUM" in plan(df) and df.count() == 40


def test_reconstruction_in_one_shuffle(spark):
    """Repeated atoms count once; what has a null equals nothing, so it is lost and rebuilt."""
    schema = "o int, r int, a string"
    old = spark.createDataFrame([(1, 1, "C"), (1, 1, "C"), (1, 2, "N"), (2, 1, "C"), (3, None, "C")], schema)
    new = spark.createDataFrame([(1, 1, "C"), (1, 2, "O"), (1, 2, "O"), (1, 3, "OXT"), (2, 1, "C"), (2, 1, "OXT"), (3, None, "C"), (4, 1, "C")], schema)
    df = assets.reconstruction(old, new, ["o"], "r", "a")
    assert "Join" not in plan(df)
    got = {x["o"]: (x["missing"], x["rebuilt"], x["affected"], x["rebuilt_share"], x["affected_share"], x["category"]) for x in df.collect()}
    assert got == {1: (1, 2, 2, 1.0, 1.0, "sidechain_completion"), 2: (0, 1, 1, 1.0, 1.0, "terminal_oxygen_only"), 3: (1, 1, 0, 1.0, None, "sidechain_completion"), 4: (0, 1, 1, None, None, "sidechain_completion")}
