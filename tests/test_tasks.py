"""Few rows are worked on in few tasks, whatever the session's number of shuffle partitions."""

from __future__ import annotations

import pytest

from bagweave.operators import graph


def tasks_of(spark, name: str, run) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := told.getStageInfo(s)))


@pytest.fixture
def many_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 40
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_rounds_over_few_edges_are_one_task_each(spark, many_partitions):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "src long, dst long")
    got = {}
    n = tasks_of(spark, "few-edges", lambda: got.update({r["id"]: r["component"] for r in graph.connected_components(chain).collect()}))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
    assert n < 10 * many_partitions


def test_many_edges_are_dealt(spark, many_partitions, monkeypatch):
    """The same components when edges need several tasks."""
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 7)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.connected_components(chain).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
