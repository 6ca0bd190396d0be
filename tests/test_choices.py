"""The diverse choice, one pick after another, and feature requests that are errors."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from bagweave.operators import allocation
from bagweave.plans import registry
from bagweave.sources import arrays

SF = "/root/testdata/sf0.001"


def test_diverse_population_is_that_of_single_picks(spark):
    rows = [(r["c_custkey"], r["c_nationkey"], r["c_mktsegment"], r["c_acctbal"] < 0) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()]
    nations, segments, chosen, left = Counter(), Counter(), [], list(rows)
    while left and len(chosen) < 60:
        pick = min(left, key=lambda r: (not r[3], nations[r[1]], segments[r[2]], hashlib.sha256(f"2026:{r[0]}".encode()).hexdigest()))
        left.remove(pick)
        chosen.append(pick[0])
        nations[pick[1]] += 1
        segments[pick[2]] += 1
    assert sorted(r["c_custkey"] for r in registry.QUERIES["diverse_population"](spark, SF).collect()) == sorted(chosen)


def test_a_choice_of_more_than_there_are_takes_all(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "x")], "id long, grp string, kind string")
    assert sorted(r["id"] for r in allocation.diverse_choice(df, "id", "grp", ["kind"], 9).collect()) == [1, 2, 3]


def test_unknown_features_are_errors(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "names array<string>, grp string, less array<string>")
    known, groups = ("a", "b", "c"), {"g": ("b", "a")}
    ask = lambda *rows: [r["features"] for r in arrays.resolved(df(*rows), "names", known, groups, "grp", "less").collect()]
    assert ask((["c", "a", "c"], "g", ["b"]), (["c", "b"], None, None), (None, "g", [])) == [["a", "c"], ["c", "b"], ["b", "a"]]
    for row, message in (((["z"], None, []), "unknown features: z"), ((["a"], "h", []), "unknown group: h"), ((["a"], None, ["y", "x"]), "unknown features: x, y")):
        with pytest.raises(Exception, match=message):
            ask(row)
