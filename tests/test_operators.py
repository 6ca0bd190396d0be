"""Operators on small hand-computed inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagweave.functions.scalar import cosine_taper, membership_digest
from bagweave.operators import allocation, audits, bags, graph, linking, policies, spatial, strata
from bagweave.sources import records, sinks
from bagweave.streaming import regions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_are_canonical_and_filtered(spark):
    p = spark.createDataFrame([("B", "A", 35.0, 90.0, 85.0, 1e-8), ("A", "B", 0.35, 0.9, 0.85, 1e-8), ("A", "A", 99.0, 99.0, 99.0, 0.0), ("A", "C", 35.0, 79.0, 99.0, 0.0)], "query string, target string, fident double, qcov double, tcov double, evalue double")
    assert rows(linking.sequence_edges(p)) == [("A", "B")]
    s = spark.createDataFrame([("x/B.cif", "A.cif", 95.0, 0.8, 0.85, 90.0, 85.0, 1e-8)], "query string, target string, prob double, qtmscore double, ttmscore double, qcov double, tcov double, evalue double")
    assert rows(linking.structure_edges(s)) == [("A", "B")]


def test_contacts_are_strict(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0)], "atom long, x double, y double, z double, radius double")
    near, far = (spark.createDataFrame([(1, d, 0.0, 0.0, 1.0)], a.schema) for d in (2.4999, 2.5))
    assert spatial.contacts(a, near, 1.0).count() == 1
    assert spatial.contacts(a, far, 1.0).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = graph.connected_components(spark.createDataFrame([*edges, (5, None)], "src long, dst long"))
    assert rows(found) == sorted((v, root(v)) for v in parent)


def test_selection_keeps_groups_and_balance(spark):
    data = [(f"P{i:03d}", f"g{i // 2}", i % 2, f"G{i % 3}") for i in range(60)]
    df = spark.createDataFrame(data, "id string, family string, label int, phenotype string")
    chosen = allocation.quota_population(df, "id", "label", "family", ["phenotype"], 1.0)
    assert chosen.count() == 60 and chosen.distinct().count() == 60
    splits = allocation.assign_splits(df, "family", {"train": 0.7, "validation": 0.15, "test": 0.15}, {"label": 2.0, "phenotype": 0.25}, forced={"g0": "train"})
    views = allocation.nested_subsets(df, "family", ["label", "phenotype"], (0.5, 0.1))
    members = df.join(splits, "family").join(views, "family")
    assert {r["failures"] for r in audits.design_audit(members, "id", "family", "split", "label", {"half": F.col("view_50"), "tenth": F.col("view_10")}).collect()} == {0}
    assert splits.filter("family = 'g0'").first()["split"] == "train"
    assert members.filter("view_50").count() == 30


def test_macro_and_ties(spark):
    p = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.9, 0), (1, 3, 0.1, 0), (2, 1, 0.5, 0)], "owner long, point long, p double, target int")
    assert rows(bags.average_precision(p, ["owner"])) == [(1, 3, 1, 0.5), (2, 1, 0, None)]
    assert rows(bags.auroc(p, ["owner"])) == [(1, 0.75), (2, None)]
    assert rows(bags.top_fraction(p, ["owner"], 0.1)) == [(1, 1, 1.0, 3.0), (2, 1, None, None)]


def test_quartiles_interpolate_and_keep_ties(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 2.0, 9.0)], "v double")
    assert [r["quartile"] for r in strata.quartile_strata(df, "v").orderBy("v").collect()] == [1, 1, 1, 1, 4]


def test_taper_and_digest(spark):
    df = spark.createDataFrame([("b",), ("a",)], "id string")
    assert df.agg(membership_digest(F.col("id")).alias("d")).first()["d"] == hashlib.sha256(b"a\nb\n").hexdigest()
    t = spark.createDataFrame([(1.0,), (2.2,), (5.0,)], "d double").select(F.round(cosine_taper(F.col("d")), 6).alias("t"))
    assert [r["t"] for r in t.collect()] == [1.0, 0.5, 0.0]


def test_latest_before_status(spark):
    r = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("b", 1, "ok")], "run string, attempt int, status string")
    assert rows(policies.latest_eligible(r, ["run"], "attempt", "status", "ok")) == [("b", 1, "ok")]


def test_scans(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"identifier":"1ABC_A_Q","sequence":"acde","label":1,"protein_copy":1}\n\n{"identifier":"2","sequence":"A1","label":1,"protein_copy":1}\n')
    got = records.evidence_jsonl(spark, f"file://{tmp_path}/e.jsonl").orderBy("identifier").collect()
    assert [(r["pdb_id"], r["protein_chain"], r["reject"]) for r in got] == [("1ABC", "A_Q", None), ("2", None, "sequence")]
    (tmp_path / "p.tsv").write_text("a\tb\t1\nc\td\n")
    assert [r["bad_width"] for r in records.exact_width_tsv(spark, f"file://{tmp_path}/p.tsv", ["q", "t", "s"]).collect()] == [False, True]
    (tmp_path / "s.fasta").write_text(">x |label=1|\nAC\nde\n>y label 0\nGG\n")
    fasta = records.fasta(spark, f"file://{tmp_path}/s.fasta")
    assert rows(fasta.select("header", "sequence", records.header_label(F.col("header")).alias("l"))) == [("x |label=1|", "ACDE", 1), ("y label 0", "GG", 0)]
    (tmp_path / "ids.txt").write_text("a/x.pdb\n# no\n\nb/x.cif\na/x.pdb\n")
    assert rows(records.id_manifest(spark, f"file://{tmp_path}/ids.txt")) == [("a/x.pdb", 1, "x"), ("b/x.cif", 2, "x_2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, [1, 2]), ("a", 0, [3])], "id string, label int, v array<int>")
    assert [r["value"] for r in sinks.id_view(df, "id", "label").collect()] == ["a\t0", "b\t1"]
    assert [r["v"] for r in sinks.csv_view(df).orderBy("id").collect()] == ["[3]", "[1,2]"]
    sinks.publish(df, f"file://{tmp_path}/out", "parquet", audit=df.limit(0))
    with pytest.raises(ValueError, match="audit"):
        sinks.publish(df, f"file://{tmp_path}/no", "parquet", audit=df)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_region_memory_expires(spark, tmp_path):
    schema = "protein long, epoch long, score double"
    for i, epoch in enumerate((1, 2, 9)):
        spark.createDataFrame([(1, epoch, float(epoch))], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = regions.memory(stream, expire=5).writeStream.format("memory").queryName("regions").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(spark.table("regions").collect(), key=lambda r: r["epoch"])
    assert (last["epoch"], last["held"], last["best"]) == (9, 1, 9.0)
