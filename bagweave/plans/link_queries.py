"""Edge, group, dedupe and split-audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions.scalar import membership_digest
from bagweave.operators import audits, linking
from bagweave.operators.graph import connected_components
from bagweave.plans.registry import query
from bagweave.plans.views import PAIRS, pairs, table

EDGES = f"""{PAIRS}, f AS (SELECT query, target, CASE WHEN fident > 1 THEN fident / 100 ELSE fident END AS fi, CASE WHEN qcov > 1 THEN qcov / 100 ELSE qcov END AS qc, CASE WHEN tcov > 1 THEN tcov / 100 ELSE tcov END AS tc, evalue FROM pairs),
edges AS (SELECT DISTINCT least(query, target) AS src, greatest(query, target) AS dst FROM f WHERE fi >= .95 AND least(qc, tc) >= .8 AND evalue <= 1e-3 AND query <> target)"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.sequence_edges(pairs(spark, sf_dir), identity=0.95)


@query(f"WITH {EDGES} SELECT * FROM edges")
def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir)


@query("""WITH p AS (SELECT 'dir/' || (l_partkey % 300) || '.cif' AS q, 'dir/' || (l_orderkey % 300) || '.cif' AS t, (l_suppkey * 7) % 101 AS prob, ((l_partkey * 3) % 101) / 100.0::DOUBLE AS a, ((l_orderkey * 5) % 101) / 100.0::DOUBLE AS b, l_tax / 10 AS e FROM lineitem),
s AS (SELECT split_part(split_part(q, '/', 2), '.', 1) AS q, split_part(split_part(t, '/', 2), '.', 1) AS t FROM p WHERE CASE WHEN prob > 1 THEN prob / 100.0::DOUBLE ELSE prob END >= .9 AND least(a, b) >= .75 AND e <= 1e-3) SELECT DISTINCT least(q, t) AS src, greatest(q, t) AS dst FROM s WHERE q <> t""")
def structure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("dir/"), (F.col(c) % 300).cast("string"), F.lit(".cif"))
    p = table(spark, sf_dir, "lineitem").select(
        name("l_partkey").alias("query"), name("l_orderkey").alias("target"), ((F.col("l_suppkey") * 7) % 101).alias("prob"), ((F.col("l_partkey") * 3) % 101 / F.lit(100.0)).alias("qtmscore"),
        ((F.col("l_orderkey") * 5) % 101 / F.lit(100.0)).alias("ttmscore"), F.lit(1.0).alias("qcov"), F.lit(1.0).alias("tcov"), (F.col("l_tax") / 10).alias("evalue"),
    )
    return linking.structure_edges(p)


STARS = """k AS (SELECT doc_id AS id, sha256(lower(coalesce(text, ''))) AS t, source || ':' || lang || ':' || (n_chars // 40) AS s FROM documents), e AS (SELECT m AS src, id AS dst, 'text' AS reason FROM (SELECT id, min(id) OVER (PARTITION BY t) AS m FROM k) WHERE m <> id
UNION ALL SELECT m, id, 'shape' FROM (SELECT id, min(id) OVER (PARTITION BY s) AS m FROM k) WHERE m <> id), stars AS (SELECT src, dst, list_sort(list(DISTINCT reason)) AS reasons FROM e GROUP BY src, dst)"""


def stars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256).alias("t"), F.concat_ws(":", "source", "lang", F.floor(F.col("n_chars") / 40).cast("string")).alias("s"))
    return linking.star_edges(k, "id", {"text": "t", "shape": "s"})


@query(f"WITH {STARS} SELECT src, dst, array_to_string(reasons, ',') AS reasons FROM stars")
def exact_key_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars_of(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH RECURSIVE {EDGES}, sides AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), reach(a, b) AS (SELECT DISTINCT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a) SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(edges_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {STARS}, sides AS (SELECT src AS a, dst AS b FROM stars UNION ALL SELECT dst, src FROM stars), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
c AS (SELECT a AS id, min(b) AS leakage_group FROM reach GROUP BY a) SELECT id, leakage_group, printf('L%05d', dense_rank() OVER (ORDER BY leakage_group)) AS group_name FROM c""")
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return linking.leakage_groups(rows, "id", [stars_of(spark, sf_dir)]).select("id", "leakage_group", "group_name")


@query(f"""WITH {EDGES} SELECT * FROM edges WHERE src NOT IN (SELECT c_custkey % 350 FROM customer) OR dst NOT IN (SELECT c_custkey % 350 FROM customer)""")
def unknown_edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 350).alias("id")).distinct()
    return linking.unknown_ends(edges_of(spark, sf_dir), ids, "id")


@query("""SELECT sha256(coalesce(text, '')) AS key, min(doc_id) AS kept, CAST(count(*) AS BIGINT) AS n, min(quality) <> max(quality) AS conflict, CASE WHEN min(quality) = max(quality) THEN min(quality) END AS label FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "quality")
    return linking.deduplicated(rows, "doc_id", "key", "quality")


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS l FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS l FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1),
j AS (SELECT a.k AS k1, b.k AS k2, a.l AS l1, b.l AS l2 FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT coalesce(k1, k2) AS k, CASE WHEN k1 IS NULL THEN 'right' WHEN k2 IS NULL THEN 'left' WHEN l1 <> l2 THEN 'conflict' ELSE 'both' END AS origin, l1, l2 FROM j)
SELECT k, origin, CASE WHEN origin <> 'conflict' THEN coalesce(l1, l2) END AS l FROM c""")
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") < 0).cast("int").alias("l"))
    b = table(spark, sf_dir, "orders").filter("o_custkey % 5 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("l"))
    return linking.merged_sources(a, b, "k", "l")


@query(f"WITH {EDGES}, m AS (SELECT DISTINCT c_custkey % 380 AS id, c_custkey % 380 % 3 AS split FROM customer) SELECT edges.src, edges.dst, a.split AS split_src, b.split AS split_dst FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.split <> b.split")
def pair_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 380).alias("id")).distinct().withColumn("split", F.col("id") % 3)
    return linking.cross_split_pairs(edges_of(spark, sf_dir), m, "id", "split").select("src", "dst", "split_src", "split_dst")


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('salt' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balanced_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.balanced_view(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", "salt")


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'stale' ELSE h END AS h, 'q' || quality AS note FROM labels JOIN d USING (doc_id)) SELECT d.doc_id, n.note FROM d LEFT JOIN n ON d.doc_id = n.doc_id AND d.h = n.h""")
def frozen_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    n = table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "stale").otherwise(F.col("h")).alias("h"), F.concat(F.lit("q"), "quality").alias("note"))
    return linking.annotated(d, n, "doc_id", "h").select("doc_id", "note")


@query("""WITH a AS (SELECT l_suppkey % 10 AS r, l_partkey AS p, sum(l_quantity) AS m FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), x AS (SELECT r, p, m, first_value(p) OVER (PARTITION BY r ORDER BY m DESC, p) AS anchor FROM a), b AS (SELECT l_suppkey % 8 AS r, l_partkey AS p, sum(l_quantity) AS m FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2),
ta AS (SELECT r, sum(m) AS t FROM x GROUP BY r), tb AS (SELECT r, sum(m) AS t FROM b GROUP BY r), o AS (SELECT x.r AS ra, b.r AS rb, sum(least(x.m, b.m)) AS o, max(CASE WHEN x.p = anchor THEN 1 ELSE 0 END) AS inside FROM x JOIN b ON x.p = b.p GROUP BY 1, 2),
l AS (SELECT ra, rb FROM o JOIN ta ON ta.r = ra JOIN tb ON tb.r = rb WHERE o >= .2 * least(ta.t, tb.t) AND inside = 1), d AS (SELECT ra, count(*) OVER (PARTITION BY ra) AS od, count(*) OVER (PARTITION BY rb) AS i FROM l), f AS (SELECT ra, max(od) AS od, max(i) AS i FROM d GROUP BY ra)
SELECT ta.r AS region, CASE WHEN od IS NULL THEN 'lost' WHEN od > 1 THEN 'split' WHEN i > 1 THEN 'merge' ELSE 'same' END AS fate FROM ta LEFT JOIN f ON ta.r = f.ra""")
def region_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.filter("l_linenumber <= 4").groupBy((F.col("l_suppkey") % 10).alias("region"), F.col("l_partkey").alias("point")).agg(F.sum("l_quantity").alias("mass"))
    a = a.join(a.groupBy("region").agg(F.max_by("point", F.struct("mass", -F.col("point"))).alias("anchor")), "region")
    b = li.filter("l_linenumber >= 3").groupBy((F.col("l_suppkey") % 8).alias("region"), F.col("l_partkey").alias("point")).agg(F.sum("l_quantity").alias("mass"))
    return linking.region_lineage(a, b, 0.2)


@query("SELECT doc_id % 3 AS split, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS digest FROM labels GROUP BY 1")
def membership_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 3).alias("split")).agg(F.count("*").alias("n"), membership_digest(F.col("doc_id").cast("string")).alias("digest"))


CHECKS = """WITH m AS (SELECT doc_id AS id, source AS g, doc_id % 3 AS split, quality AS l FROM documents JOIN labels USING (doc_id))"""


@query(f"""{CHECKS} SELECT 'unique_ids' AS name, CAST(count(*) AS BIGINT) AS failures FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'crossing_groups', count(*) FROM (SELECT g FROM m GROUP BY g HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'missing_class', count(*) FROM (SELECT split FROM m GROUP BY split HAVING count(DISTINCT l) < 2) UNION ALL SELECT 'not_nested', count(*) FROM m WHERE id % 10 = 0 AND id % 2 <> 0 UNION ALL SELECT 'fragmented_groups', count(*) FROM (SELECT g FROM m GROUP BY g HAVING count(*) FILTER (id % 2 = 0) NOT IN (0, count(*)))""")
def design_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("g"), (F.col("doc_id") % 3).alias("split"), F.col("quality").alias("l"))
    return audits.design_audit(m, "id", "g", "split", "l", {"half": F.col("id") % 2 == 0, "tenth": F.col("id") % 10 == 0})


@query("""WITH a AS (SELECT doc_id AS id, lang AS v FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS v FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'unexpected' WHEN b.id IS NULL THEN 'missing' ELSE 'mismatch' END AS finding FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v IS DISTINCT FROM b.v""")
def catalog_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("v"))
    return audits.differences(d.filter("id % 7 <> 0"), d.filter("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 11 == 0, "xx").otherwise(F.col("v"))), "id", ["v"])


@query("""WITH m AS (SELECT lang AS p, source AS g, hash_split AS s FROM (SELECT *, CASE WHEN lang = 'es' THEN doc_id % 2 ELSE doc_id % 3 END AS hash_split FROM documents)), a AS (SELECT p, count(DISTINCT g) AS groups, list_sort(list(DISTINCT s)) AS seen FROM m GROUP BY p)
SELECT p, CAST(groups AS BIGINT) AS groups, array_to_string(list_filter([0, 1, 2], lambda x: NOT list_contains(seen, x)), ',') AS absent FROM a WHERE groups >= 3 AND len(seen) < 3""")
def phenotype_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select(F.col("lang").alias("p"), F.col("source").alias("g"), F.when(F.col("lang") == "es", F.col("doc_id") % 2).otherwise(F.col("doc_id") % 3).alias("s"))
    return audits.coverage_gaps(m, "p", "g", "s", [0, 1, 2], least=3).select("p", "groups", F.array_join("absent", ",").alias("absent"))


@query("""SELECT doc_id AS id, concat_ws(',', CASE WHEN o.doc_id IS NOT NULL THEN 'used' END, CASE WHEN quality <> 0 THEN 'positive' END) AS reasons FROM labels LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) o USING (doc_id) WHERE doc_id % 3 = 0 AND (o.doc_id IS NOT NULL OR quality <> 0)""")
def reserve_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reserve = table(spark, sf_dir, "labels").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    used = table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"))
    return audits.reserve_violations(reserve, used, "id", "label").select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT l_suppkey AS key, CAST(count(DISTINCT l_shipdate) AS BIGINT) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) > 1""")
def conflicting_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.conflicting(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate").select(F.col("l_suppkey").alias("key"), "versions")
