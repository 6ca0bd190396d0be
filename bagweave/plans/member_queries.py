"""Queries of gated reads, validated writes, staged documents, and of members' sources and tags."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions.lineage import cut, ensure_shared_dir
from bagweave.functions.ranged import ranged_places
from bagweave.operators import assets, fields, structures
from bagweave.plans.asset_queries import VIEWS, member_views, sha
from bagweave.plans.registry import query
from bagweave.plans.spatial_queries import near
from bagweave.plans.study_queries import rounded
from bagweave.plans.views import atoms, table
from bagweave.sources import arrays, readers


def place(spark: SparkSession, name: str) -> str:
    return f"{ensure_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width, 0.0::DOUBLE AS curvature FROM embeddings")
def array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.lit("3.0").alias("schema_version"), "vec_id", "label", F.size("embedding").alias("width"), "embedding")
    families = {"identity": ["vec_id", "label"], "shape": ["width", "curvature"], "field": ["embedding"]}
    return arrays.array_table(df, "3.0", ["vec_id", "embedding"], {"curvature": F.lit(0.0)}, families, ["identity", "shape"])


@query("""SELECT 'm' || CAST(vec_id // 64 AS VARCHAR) AS name, vec_id, label, CAST(len(embedding) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS x, 0.5::DOUBLE AS curvature FROM embeddings WHERE vec_id // 64 <> 1""")
def array_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of 64 vectors each, written and read back by the arrays that are wanted; one of them is pruned by its name."""
    path = place(spark, "archives")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.floor(F.col("vec_id") / 64).cast("string")).alias("member"), "vec_id", "label", "embedding")
    readers.write_archives(rows, "member", ["vec_id", "label", "embedding"], "3.0", path).write.format("noop").mode("overwrite").save()
    readers.register(spark)
    wanted = "name string, vec_id array<bigint>, label array<int>, embedding array<array<float>>, curvature double"
    read = spark.read.format("array_archive").schema(wanted).option("version", "3.0").option("required", "vec_id,embedding").option("defaults", '{"curvature": 0.5}').option("bytes", 1 << 18).load(path)
    pruned = read.filter("name <> 'm1'")
    each = pruned.select("name", "curvature", F.explode(F.arrays_zip("vec_id", "label", "embedding")).alias("r"))
    return each.select("name", "r.vec_id", "r.label", F.size("r.embedding").alias("width"), F.round(F.col("r.embedding")[0].cast("double"), 6).alias("x"), "curvature")


SITES = """a AS (SELECT 's' || CAST(vec_id // 50 AS VARCHAR) AS file, CAST(vec_id % 50 AS INTEGER) AS residue_number, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, floor(CAST(embedding[1] AS DOUBLE) * 1000) / 100 AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) / 100 AS y, floor(CAST(embedding[3] AS DOUBLE) * 1000) / 100 AS z, vec_id FROM embeddings),
b AS (SELECT a.*, alt, CASE WHEN alt = 'A' THEN (vec_id % 10) / 10.0::DOUBLE ELSE 0.5::DOUBLE END AS occupancy, CASE WHEN alt = 'A' THEN a.x ELSE a.x + 1 END AS px FROM a, (VALUES ('A'), ('B')) v(alt))"""


@query(f"""WITH {SITES}, r AS (SELECT *, row_number() OVER (PARTITION BY file, residue_number ORDER BY occupancy DESC, alt) AS k FROM b WHERE chain = 'A')
SELECT file, residue_number, alt AS altloc, round(px - avg(px) OVER (PARTITION BY file), 6) AS x, round(y - avg(y) OVER (PARTITION BY file), 6) AS y, round(z - avg(z) OVER (PARTITION BY file), 6) AS z FROM r WHERE k = 1""")
def structure_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of 50 sites, as mmCIF and PDB files in turn, with two models and two alternatives of each atom; read back by model and chain, reduced and centred."""
    path = place(spark, "structures")
    e = F.col("embedding")
    two = F.floor(e[0].cast("double") * 1000) / 100, F.floor(e[1].cast("double") * 1000) / 100, F.floor(e[2].cast("double") * 1000) / 100
    sites = table(spark, sf_dir, "embeddings").withColumns(dict(zip("xyz", two, strict=True))).withColumn("k", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("alt")) for m in (1, 2) for a in "AB"))))
    atoms = sites.select(
        F.concat(F.lit("s"), F.floor(F.col("vec_id") / 50).cast("string")).alias("file"), F.when(F.floor(F.col("vec_id") / 50) % 2 == 0, "cif").otherwise("pdb").alias("format"), "k.model", F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("chain"),
        F.lit("GLY").alias("residue_name"), (F.col("vec_id") % 50).cast("int").alias("residue_number"), F.col("k.alt").alias("altloc"), F.lit("CA").alias("atom_name"), F.lit("C").alias("element"), (F.col("x") + F.when(F.col("k.alt") == "B", 1).otherwise(0) + F.when(F.col("k.model") == 2, 5).otherwise(0)).alias("x"), "y", "z",
        F.when(F.col("k.alt") == "A", F.col("vec_id") % 10 / 10.0).otherwise(0.5).alias("occupancy"), F.lit(1.5).alias("b_iso"), F.lit(False).alias("hetero"), (F.col("vec_id") * 2 + F.when(F.col("k.alt") == "B", 1).otherwise(0)).alias("place"),
    )
    readers.write_atoms(atoms, path, "place").write.format("noop").mode("overwrite").save()
    readers.register(spark)
    read = spark.read.format("atom_file").option("bytes", 1 << 16).load(path).filter((F.col("model") == 1) & (F.col("chain") == "A"))
    kept = assets.centred(assets.reduced_sites(read, ["file"], "residue_number", "occupancy", "altloc"), ["file"], ("x", "y", "z"))
    return kept.select("file", "residue_number", "altloc", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"WITH {VIEWS} SELECT id, grp FROM v WHERE split = 'train' AND list_contains(views, 'half')")
def managed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = member_views(spark, sf_dir).withColumn("task", F.lit("binding"))
    return arrays.managed_index(members, "train", "half").select("id", "grp")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size % 2 AS label, CASE WHEN p_size % 5 = 0 THEN 'test' ELSE 'train' END AS split, p_brand AS \"group\" FROM part")
def legacy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "identifier,label,split,group"
    p = table(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", F.col("p_size") % 2, F.when(F.col("p_size") % 5 == 0, "test").otherwise("train"), "p_brand").alias("value"))
    return arrays.legacy_manifest(p.unionAll(spark.createDataFrame([(header,)], "value string")), header)


@query("""SELECT 'catalog' AS part, CAST(count(*) AS BIGINT) AS rows FROM part UNION ALL SELECT 'edges', CAST(count(DISTINCT (l_partkey, l_suppkey)) AS BIGINT) FROM lineitem UNION ALL SELECT 'groups', CAST(count(DISTINCT p_brand) AS BIGINT) FROM part UNION ALL SELECT 'train', CAST(count(*) FILTER (p_size % 5 <> 0) AS BIGINT) FROM part""")
def published_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parts = {
        "catalog": p, "edges": table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "groups": p.groupBy("p_brand").agg(F.count("*").alias("members")), "train": p.filter("p_size % 5 <> 0").select("p_partkey"),
    }
    path = place(spark, "design")
    out = arrays.published_design(spark, parts, path)
    arrays.removed(path)
    return out


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS equal FROM orders")
def validated_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, path = table(spark, sf_dir, "orders"), place(spark, "archive")
    rows, digest = arrays.validated_write(o, path)
    equal = (rows, digest) == arrays.frame_digest(spark.read.parquet(path))
    arrays.removed(path)
    return spark.createDataFrame([(rows, equal)], "rows long, equal boolean")


@query("SELECT c_custkey AS member, sha256(CAST(c_nationkey AS VARCHAR)) AS parent, round(c_acctbal, 4) AS shape_balance FROM customer")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar written with its parents' digests and read back under its family's name."""
    c, path = table(spark, sf_dir, "customer"), place(spark, "sidecar")
    base = c.select(F.col("c_custkey").alias("member"), sha("c_nationkey").alias("parent"))
    arrays.validated_write(base.join(c.select(F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("shape_balance")), "member"), path)
    out = cut(rounded(base.join(spark.read.parquet(path), ["member", "parent"]), 4))
    arrays.removed(path)
    return out


@query("SELECT event_id, sha256(props) AS digest, CAST(octet_length(encode(props)) AS INTEGER) AS bytes, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS parsed FROM events")
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.receipts(table(spark, sf_dir, "events"), "event_id", "props", {"k": "int"})


@query("SELECT event_id AS id, event_type AS term FROM events")
def staged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("page"), F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("term")).alias("item"))
    pages = e.groupBy("page").agg(F.to_json(F.collect_list("item")).alias("items")).withColumn("total", F.lit(e.count()))
    return arrays.staged_pages(pages, "total", "items", "struct<id: bigint, term: string>")


KNOWN = ("signup", "view", "click", "purchase", "error")
GROUPS = {"buying": ("purchase", "click"), "coming": ("signup", "view", "click")}


@query("""WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS names, list_sort(list(DISTINCT CASE WHEN event_id % 3 = 0 THEN 'error' WHEN event_id % 50 = 1 THEN 'view' END) FILTER (event_id % 3 = 0 OR event_id % 50 = 1)) AS less FROM events GROUP BY user_id),
a AS (SELECT user_id, list_concat(CASE user_id % 3 WHEN 0 THEN ['purchase', 'click'] WHEN 1 THEN ['signup', 'view', 'click'] ELSE [] END, names) AS asked, coalesce(less, []) AS less FROM u), e AS (SELECT user_id, unnest(asked) AS feature, generate_subscripts(asked, 1) AS k, less FROM a), f AS (SELECT user_id, feature, min(k) AS k FROM e WHERE NOT list_contains(less, feature) GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) AS INTEGER) AS place, feature FROM f""")
def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that each user's events ask for, with a group and exclusions by user and event."""
    less = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 50 == 1, "view")
    asked = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"), F.collect_set(less).alias("less"))
    requests = asked.withColumn("group", F.when(F.col("user_id") % 3 == 0, "buying").when(F.col("user_id") % 3 == 1, "coming"))
    found = arrays.resolved(requests, "names", KNOWN, GROUPS, "group", "less")
    return found.select("user_id", F.posexplode("features").alias("k", "feature")).select("user_id", (F.col("k") + 1).alias("place"), "feature")


@query("""WITH a AS (SELECT l_orderkey AS member, CASE l_linenumber % 3 WHEN 0 THEN 'surface' WHEN 1 THEN 'graph' ELSE 'spectral' END AS family, l_suppkey % 3 AS parent FROM lineitem)
SELECT member, CAST(count(DISTINCT family) AS BIGINT) AS families, CAST(count(DISTINCT parent) AS BIGINT) AS parents, CASE WHEN count(DISTINCT parent) > 1 THEN 'foreign parent' WHEN count(DISTINCT family) < 3 THEN 'incomplete' ELSE 'bound' END AS state FROM a GROUP BY member""")
def asset_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("member"), F.when(k == 0, "surface").when(k == 1, "graph").otherwise("spectral").alias("family"), (F.col("l_suppkey") % 3).alias("parent"))
    c = a.groupBy("member").agg(F.countDistinct("family").alias("families"), F.countDistinct("parent").alias("parents"))
    return c.withColumn("state", F.when(F.col("parents") > 1, "foreign parent").when(F.col("families") < 3, "incomplete").otherwise("bound"))


@query("""WITH p AS (SELECT o_orderkey AS member, sha256(CAST(o_custkey AS VARCHAR)) AS parent, 'gap=3' AS parameters FROM orders), d AS (SELECT l_orderkey AS member, sha256(CAST(min(o_custkey) + CASE WHEN sum(l_linenumber) % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS parent, CASE WHEN max(l_suppkey) % 5 = 0 THEN 'gap=2' ELSE 'gap=3' END AS parameters FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT member, CASE WHEN d.parent IS NULL THEN 'absent' WHEN d.parent <> p.parent THEN 'parent changed' WHEN d.parameters <> p.parameters THEN 'parameters changed' ELSE 'resumed' END AS state FROM p LEFT JOIN d USING (member)""")
def resume_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), "o_custkey")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("member")).agg(F.sum("l_linenumber").alias("s"), F.max("l_suppkey").alias("m"))
    d = li.join(o, "member").select("member", sha(F.col("o_custkey") + F.when(F.col("s") % 4 == 0, 1).otherwise(0)).alias("had"), F.when(F.col("m") % 5 == 0, "gap=2").otherwise("gap=3").alias("with"))
    j = o.withColumn("parent", sha("o_custkey")).join(d, "member", "left")
    return j.select("member", F.when(F.col("had").isNull(), "absent").when(F.col("had") != F.col("parent"), "parent changed").when(F.col("with") != "gap=3", "parameters changed").otherwise("resumed").alias("state"))


@query("""WITH k AS (SELECT upper(trim(p_name)) || ':' || p_size AS key, p_partkey AS id, p_type AS residues FROM part), s AS (SELECT key, min(id) AS source, min(residues) AS residues, count(DISTINCT residues) AS kinds FROM k GROUP BY key)
SELECT l_orderkey * 10 + l_linenumber AS member, CASE WHEN s.key IS NULL THEN 'no source' WHEN kinds > 1 THEN 'ambiguous' WHEN s.residues <> p_type THEN 'residues differ' ELSE 'recovered' END AS state FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN s ON s.key = upper(p_name) || ':' || (p_size + CASE WHEN l_partkey % 31 = 0 THEN 100 ELSE 0 END)""")
def recovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    key = lambda size: F.concat(F.upper(F.trim("p_name")), F.lit(":"), size.cast("string"))
    s = p.groupBy(key(F.col("p_size")).alias("key")).agg(F.min("p_type").alias("residues"), F.countDistinct("p_type").alias("kinds"))
    li = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("key", key(F.col("p_size") + F.when(F.col("l_partkey") % 31 == 0, 100).otherwise(0)))
    j = li.join(s, "key", "left")
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), F.when(F.col("kinds").isNull(), "no source").when(F.col("kinds") > 1, "ambiguous").when(F.col("residues") != F.col("p_type"), "residues differ").otherwise("recovered").alias("state"))


@query("""WITH j AS (SELECT user_id, json_extract_string(props, '$.k') AS k, value FROM events), a AS (SELECT user_id, CAST(count(*) AS BIGINT) AS annotations, CAST(count(DISTINCT k) AS BIGINT) AS terms, min(k) AS first_term FROM j GROUP BY 1)
SELECT c_custkey AS member, CASE WHEN c_nationkey % 2 = 0 THEN annotations END AS annotations, CASE WHEN c_nationkey % 2 = 0 THEN terms END AS terms, CASE WHEN c_nationkey % 2 = 0 THEN first_term END AS first_term FROM customer LEFT JOIN a ON user_id = c_custkey""")
def enriched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of nested documents for members whose sequence is the annotated one (here: of even nations)."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    a = e.groupBy("user_id").agg(F.count("*").alias("annotations"), F.countDistinct("k").alias("terms"), F.min("k").alias("first_term"))
    j = table(spark, sf_dir, "customer").join(a, F.col("user_id") == F.col("c_custkey"), "left")
    same = F.col("c_nationkey") % 2 == 0
    return j.select(F.col("c_custkey").alias("member"), *(F.when(same, F.col(c)).alias(c) for c in ("annotations", "terms", "first_term")))


@query("""WITH s AS (SELECT l_orderkey AS id, 'L' || (l_suppkey % 6) AS tag FROM lineitem), t AS (SELECT id, string_agg(tag, '+' ORDER BY tag) AS local FROM (SELECT DISTINCT id, tag FROM s) GROUP BY id)
SELECT o_orderkey AS id, 'G' || (o_custkey % 4) AS global, CASE WHEN o_orderstatus = 'F' THEN coalesce(local, '') END AS local FROM orders LEFT JOIN t ON id = o_orderkey""")
def phenotype_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone's global phenotype; of positives also the sorted local ones of their sites."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("L"), (F.col("l_suppkey") % 6).cast("string")))), "+").alias("tags"))
    o = table(spark, sf_dir, "orders").join(t, F.col("o_orderkey") == F.col("id"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("G"), (F.col("o_custkey") % 4).cast("string")).alias("global"), F.when(F.col("o_orderstatus") == "F", F.coalesce("tags", F.lit(""))).alias("local"))


CHECKS = {
    "site without donors": "l_quantity < 2", "late shipment": "l_shipdate >= TIMESTAMP '2001-01-01 00:00:00'", "free of charge": "l_extendedprice <= 0", "discount over tax": "l_discount > l_tax + 0.05",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST(count(*) FILTER ({c}) AS BIGINT) AS failures, CAST(min(CASE WHEN {c} THEN l_orderkey END) AS BIGINT) AS first FROM lineitem" for n, c in CHECKS.items()))
def metal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check's failures and the first member that fails, in one pass."""
    li = table(spark, sf_dir, "lineitem")
    a = li.agg(*(F.struct(F.count_if(F.expr(c)).alias("failures"), F.min(F.when(F.expr(c), F.col("l_orderkey"))).alias("first")).alias(f"c{i}") for i, c in enumerate(CHECKS.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}.failures").alias("failures"), F.col(f"c{i}.first").alias("first")) for i, n in enumerate(CHECKS)))
    return a.select(F.explode(rows).alias("r")).select("r.*")


@query(f"""WITH {near(0.6)}, q AS (SELECT p.a AS i, p.b AS j, q.b AS k, r.b AS l FROM near p JOIN near q ON q.a = p.b AND q.b <> p.a JOIN near r ON r.a = q.b AND r.b <> p.b AND r.b <> p.a WHERE p.a < r.b),
v AS (SELECT i, j, k, l, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - b.x AS vx, c.y - b.y AS vy, c.z - b.z AS vz, d.x - c.x AS wx, d.y - c.y AS wy, d.z - c.z AS wz FROM q JOIN atoms a ON a.atom = i JOIN atoms b ON b.atom = j JOIN atoms c ON c.atom = k JOIN atoms d ON d.atom = l),
n AS (SELECT *, uy * vz - uz * vy AS mx, uz * vx - ux * vz AS my, ux * vy - uy * vx AS mz, vy * wz - vz * wy AS nx, vz * wx - vx * wz AS ny, vx * wy - vy * wx AS nz FROM v)
SELECT i, j, k, l, round(atan2(sqrt(vx * vx + vy * vy + vz * vz) * (ux * nx + uy * ny + uz * nz), mx * nx + my * ny + mz * nz), 5) AS torsion FROM n""")
def torsions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed dihedral angles of all bonded paths of four atoms, each path once."""
    return structures.dihedrals(atoms(spark, sf_dir), "atom", 0.6, 5)


@query()
def independent_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings kept greedily by id score whose cosine with all kept before is under 0.5."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(1000)).alias("score"))
    return ranged_places(structures.independent_directions(e, "vec_id", "embedding", "score", 0.5), [F.desc("score"), F.col("vec_id")], "place").select((F.col("place") - 1).alias("place"), "vec_id")


@query()
def surface_curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.curvatures(atoms(spark, sf_dir).select("owner", "atom", "x", "y", "z", "nx", "ny", "nz"), "owner", "atom", 12)
