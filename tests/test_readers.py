"""The file formats: gates, pruning, partitions, and names of very many groups."""

from __future__ import annotations

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagweave.operators import linking, policies
from bagweave.sources import readers


def archive(folder, name: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    (folder / f"{name}.npz").write_bytes(out.getvalue())


WANTED = "name string, ids array<bigint>, field array<array<float>>, scale double"


@pytest.fixture
def archives(spark, tmp_path):
    readers.register(spark)
    for i in range(6):
        archive(tmp_path, f"m{i}", schema_version=np.array("3.0"), ids=np.arange(i), field=np.ones((i, 2), np.float32), unread=np.array([object] if i == 9 else [1]))
    return tmp_path


def load(spark, folder, schema=WANTED, **options):
    given = {"version": "3.0", "required": "ids,field", "defaults": '{"scale": 2.0}'} | options
    return spark.read.format("array_archive").schema(schema).options(**given).load(f"file://{folder}")


def test_archives_are_read_by_schema(spark, archives):
    rows = {r["name"]: r for r in load(spark, archives).collect()}
    assert sorted(rows) == [f"m{i}" for i in range(6)] and rows["m3"]["ids"] == [0, 1, 2] and rows["m2"]["field"] == [[1.0, 1.0]] * 2 and rows["m0"]["scale"] == 2.0
    assert load(spark, archives, "ids array<bigint>").columns == ["ids"]
    assert load(spark, archives, bytes="1").rdd.getNumPartitions() == 6 and load(spark, archives).rdd.getNumPartitions() == 1


def test_a_name_prunes_files_before_they_are_opened(spark, archives):
    (archives / "broken.npz").write_bytes(b"no archive")
    assert sorted(r["name"] for r in load(spark, archives).filter("name in ('m1', 'm4', 'mX')").collect()) == ["m1", "m4"]
    assert load(spark, archives).filter("name = 'm5'").count() == 1 and load(spark, archives).filter("name <> 'broken'").count() == 6
    with pytest.raises(Exception, match="broken.npz: not an array archive"):
        load(spark, archives).collect()


def test_gates_of_archives(spark, archives):
    for message, options in (("m0.npz: schema version 3.0, not 4.0", {"version": "4.0"}), ("required arrays are missing: .'area'.", {"required": "ids,area"}), ("no array scale, and no default", {"defaults": "{}"})):
        with pytest.raises(Exception, match=message):
            load(spark, archives, **options).collect()
    with pytest.raises(Exception, match="array ids has 1 dimensions, not 2"):
        load(spark, archives, "ids array<array<bigint>>").collect()
    archive(archives, "old", ids=np.arange(1), field=np.ones((1, 2)))
    with pytest.raises(Exception, match="old.npz: schema version None"):
        load(spark, archives).collect()


PDB = """HEADER    X
SSBOND   1 CYS A    2    CYS B    9
MODEL        1
ATOM      1  N   CYS A   2      11.104   6.134  -6.504  0.40 10.00           N
ATOM      2  CA ACYS A   2      11.639   6.071  -5.147  0.40 10.50           C
ATOM      3  CA BCYS A   2      11.700   6.100  -5.200  0.60 11.50           C
HETATM    4 ZN    ZN B   9A      1.000  -2.000   3.000
ENDMDL
MODEL        2
ATOM      1  N   CYS A   2      99.000   6.134  -6.504  1.00 10.00           N
ENDMDL
END
"""
CIF = """data_x
# a comment
_exptl.method 'X-RAY DIFFRACTION'
loop_
_struct_conn.id
_struct_conn.conn_type_id
_struct_conn.ptnr1_auth_asym_id
_struct_conn.ptnr1_auth_seq_id
_struct_conn.ptnr1_label_atom_id
_struct_conn.ptnr2_auth_asym_id
_struct_conn.ptnr2_auth_seq_id
_struct_conn.ptnr2_label_atom_id
d1 disulf A 2 SG B 9 SG
_note.text
;many words here; and loop_
_atom_site.fake
;
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.label_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.type_symbol
ATOM "O5'" . DA A Z 1 1.5 2.5 -3.5 ? O
ATOM 'C 1' B DA A Z 1 1.0 2.0 3.0 0.25 C
HETATM ZN . ZN B . 2 0 0 0 1 Zn
"""


def test_coordinate_files(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "p.pdb").write_text(PDB)
    (tmp_path / "c.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    read = spark.read.format("atom_file").load(f"file://{tmp_path}")
    assert read.count() == 8
    pdb = read.filter("file = 'p' and model = 1").collect()
    assert [(r["chain"], r["residue_number"], r["insertion"], r["altloc"], r["atom_name"], r["element"], r["x"], r["occupancy"], r["b_iso"], r["hetero"]) for r in pdb] == [
        ("A", 2, None, None, "N", "N", 11.104, 0.4, 10.0, False), ("A", 2, None, "A", "CA", "C", 11.639, 0.4, 10.5, False), ("A", 2, None, "B", "CA", "C", 11.7, 0.6, 11.5, False), ("B", 9, "A", None, "ZN", "Z", 1.0, 1.0, None, True),
    ]
    cif = read.filter((F.col("file") == "c") & F.col("chain").isin("A")).collect()
    assert [(r["model"], r["chain"], r["atom_name"], r["altloc"], r["z"], r["occupancy"], r["element"]) for r in cif] == [(1, "A", "O5'", None, -3.5, 1.0, "O"), (1, "A", "C 1", "B", 3.0, 0.25, "C")]
    links = spark.read.format("atom_file").option("content", "links").load(f"file://{tmp_path}").orderBy("file").collect()
    assert [tuple(r) for r in links] == [(f, "disulf", "A", 2, "SG", "B", 9, "SG") for f in "cp"]
    for name, text, message in (("none", "HEADER\n", "no atoms"), ("nan", PDB.replace("11.104", "   nan"), "not finite"), ("number", PDB.replace("CYS A   2      11.104", "CYS A          11.104"), "no residue number")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.pdb").write_text(text)
        with pytest.raises(Exception, match=message):
            spark.read.format("atom_file").load(f"file://{tmp_path}/{name}").collect()


def test_names_of_many_groups_are_distinct(spark):
    rows = spark.range(100_001).withColumnRenamed("id", "doc")
    edges = spark.createDataFrame([(0, 100_000), (7, 8)], "src long, dst long")
    got = linking.leakage_groups(rows, "doc", [edges])
    assert got.select("group_name").distinct().count() == 99_999
    named = {r["doc"]: r["group_name"] for r in got.filter("doc in (0, 7, 8, 9, 99999, 100000)").collect()}
    assert named == {0: "L00001", 100_000: "L00001", 7: "L00008", 8: "L00008", 9: "L00009", 99_999: "L99999"}


def test_pareto_front_of_ties(spark):
    points = [(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 1.0, 4.0), (4, 2.0, 5.0), (5, 2.0, 6.0), (6, 3.0, 6.0), (7, 0.5, 1.0), (8, 9.0, 7.0)]
    got = policies.pareto(spark.createDataFrame(points, "id long, low double, high double"), "id", "low", "high")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 5, 7, 8]
