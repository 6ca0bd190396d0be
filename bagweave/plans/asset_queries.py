"""Asset, catalog, assembly and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.operators import assets as ops
from bagweave.plans.registry import query
from bagweave.plans.study_queries import rounded
from bagweave.plans.views import ATOMS, atoms, table

sha = lambda c: F.sha2(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), 256)


@query("""WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, sha256(CAST(max(o_orderkey) % 25 AS VARCHAR)) AS d FROM orders GROUP BY 1)
SELECT c_custkey AS member, sha256(CAST(c_nationkey AS VARCHAR)) AS digest, CASE WHEN d = sha256(CAST(c_nationkey AS VARCHAR)) THEN round(total, 4) END AS orders_total, CASE WHEN k IS NULL THEN 'absent' WHEN d = sha256(CAST(c_nationkey AS VARCHAR)) THEN 'bound' ELSE 'stale' END AS orders_state FROM customer LEFT JOIN s ON k = c_custkey""")
def bound_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), sha("c_nationkey").alias("digest"))
    side = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.sum("o_totalprice").alias("total"), sha(F.max("o_orderkey") % 25).alias("digest"))
    return rounded(ops.bound_sidecar(base, side, "member", "digest", "orders"), 4)


FAMILIES = [("surface", 0, "h=1"), ("graph", 1, "k=6"), ("spectral", 2, "m=64")]


@query("""WITH f(family, stage, parameters) AS (VALUES ('surface', 0, 'h=1'), ('graph', 1, 'k=6'), ('spectral', 2, 'm=64')), m AS (SELECT c_custkey AS member, c_nationkey AS parent FROM customer),
done AS (SELECT DISTINCT o_custkey AS member, CASE o_orderkey % 3 WHEN 0 THEN 'surface' WHEN 1 THEN 'graph' ELSE 'spectral' END AS family, CASE o_orderkey % 3 WHEN 0 THEN 'h=1' WHEN 1 THEN 'k=6' ELSE 'm=32' END AS parameters, c_nationkey AS parent FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT m.member, f.family, f.stage FROM m, f WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.member = m.member AND d.family = f.family AND d.parameters = f.parameters AND d.parent = m.parent))
SELECT member, family, stage, stage = 0 OR EXISTS (SELECT 1 FROM done d JOIN f ON d.family = f.family AND d.parameters = f.parameters WHERE d.member = l.member AND f.stage + 1 = l.stage) AS ready FROM l""")
def pending_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("parent"))
    kind = F.col("o_orderkey") % 3
    done = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("member"), F.when(kind == 0, "surface").when(kind == 1, "graph").otherwise("spectral").alias("family"), F.when(kind == 0, "h=1").when(kind == 1, "k=6").otherwise("m=32").alias("parameters"),
    ).distinct().join(members, "member")
    return ops.pending_assets(members, spark.createDataFrame(FAMILIES, "family string, stage int, parameters string"), done, "member")


@query("""WITH e AS (SELECT o_orderkey AS member, sha256(CAST(o_custkey AS VARCHAR)) AS e FROM orders), f AS (SELECT l_orderkey + CASE WHEN l_orderkey % 97 = 0 THEN 1000000000 ELSE 0 END AS member, sha256(CAST(min(o_custkey) + CASE WHEN max(l_suppkey) % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT member, CASE WHEN e IS NULL THEN 'unexpected' WHEN f IS NULL THEN 'missing' ELSE 'changed' END AS fault FROM e FULL JOIN f USING (member) WHERE e IS NULL OR f IS NULL OR e <> f""")
def checksum_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_suppkey").alias("s")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 97 == 0, 1000000000).otherwise(0)
    found = found.select(key.alias("member"), sha(F.col("o_custkey") + F.when(F.col("s") % 50 == 0, 1).otherwise(0)).alias("digest"))
    return ops.digest_mismatches(o.select(F.col("o_orderkey").alias("member"), sha("o_custkey").alias("digest")), found, "member", "digest")


VIEWS = """v AS (SELECT p_partkey AS id, p_brand AS grp, CASE WHEN p_size % 5 = 0 THEN 'test' ELSE 'train' END AS split, p_size AS size, list_filter(['half', 'quarter'], lambda x: (x = 'half' AND p_size % 2 = 0) OR (x = 'quarter' AND p_size % 4 = 0)) AS views FROM part)"""


def member_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    views = F.array_compact(F.array(F.when(size % 2 == 0, "half"), F.when(size % 4 == 0, "quarter")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.when(size % 5 == 0, "test").otherwise("train").alias("split"), size.alias("size"), views.alias("views"))


@query(f"""WITH {VIEWS}, x AS (SELECT unnest(list_prepend('full', views)) AS view, size FROM v WHERE split = 'train') SELECT view, CAST(count(*) AS BIGINT) AS n, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS sd FROM x GROUP BY view""")
def view_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.view_moments(member_views(spark, sf_dir).filter("split = 'train'"), "views", "size"))


@query(f"""WITH {VIEWS}, p AS (SELECT unnest(views) AS view, id, size FROM v WHERE split = 'train'), f AS (SELECT unnest(views) AS view, id, size + CASE WHEN id % 41 = 0 THEN 1 ELSE 0 END AS size FROM v WHERE id % 37 <> 0 AND (split = 'train' OR id % 29 = 0)),
d AS (SELECT view, CAST(count(*) FILTER (f.id IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (p.id IS NULL) AS BIGINT) AS foreign, CAST(count(*) FILTER (f.size <> p.size) AS BIGINT) AS changed FROM p FULL JOIN f USING (view, id) GROUP BY view) SELECT view, missing, "foreign", changed, missing + "foreign" + changed = 0 AS equal FROM d""".replace("AS foreign,", 'AS "foreign",'))
def population_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = member_views(spark, sf_dir)
    fit = v.filter("id % 37 <> 0 and (split = 'train' or id % 29 = 0)").select(F.explode("views").alias("view"), "id", (F.col("size") + F.when(F.col("id") % 41 == 0, 1).otherwise(0)).alias("size"))
    return ops.population_differences(fit, v.filter("split = 'train'").select(F.explode("views").alias("view"), "id", "size"), "view", "id", "size")


@query(f"""WITH {VIEWS}, w AS (SELECT 'r' || (id % 2) AS view, CASE WHEN size % 4 = 0 THEN 1 WHEN size % 4 = 2 THEN 2 ELSE 3 END AS first, id, grp, split FROM v), l AS (SELECT view, level, id + CASE WHEN id % 83 = 0 AND level = 3 THEN 100000000 ELSE 0 END AS id FROM w, range(1, 4) r(level) WHERE first <= level AND NOT (id % 71 = 0 AND level = 3)),
k AS (SELECT l.view, l.level, l.id, v.grp, v.split FROM l LEFT JOIN v ON l.id = v.id), b AS (SELECT view, level, count(*) AS size, count(*) FILTER (split IS NULL) AS unknown, count(*) FILTER (split <> 'train') AS non_train FROM k GROUP BY ALL),
o AS (SELECT l.view, l.level + 1 AS level, count(*) AS lost FROM l WHERE l.level < 3 AND NOT EXISTS (SELECT 1 FROM l m WHERE m.view = l.view AND m.level = l.level + 1 AND m.id = l.id) GROUP BY ALL),
s AS (SELECT grp, count(*) AS whole FROM v WHERE split = 'train' GROUP BY grp), h AS (SELECT view, level, grp, count(*) AS held FROM k WHERE split = 'train' GROUP BY ALL), f AS (SELECT view, level, count(*) FILTER (held < whole) AS fragmented, count(*) AS groups FROM h JOIN s USING (grp) GROUP BY ALL)
SELECT view, CAST(level AS INTEGER) AS level, CAST(size AS BIGINT) AS size, CAST(unknown AS BIGINT) AS unknown, CAST(non_train AS BIGINT) AS non_train, CAST(coalesce(lost, 0) AS BIGINT) AS lost, CAST(coalesce(fragmented, 0) AS BIGINT) AS fragmented, CAST(coalesce(groups, 0) AS BIGINT) AS groups FROM b LEFT JOIN o USING (view, level) LEFT JOIN f USING (view, level)""")
def dilution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = member_views(spark, sf_dir)
    first = F.when(F.col("size") % 4 == 0, 1).when(F.col("size") % 4 == 2, 2).otherwise(3)
    rows = v.select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("view"), "id", F.explode(F.sequence(first, F.lit(3))).alias("level")).filter("not (id % 71 = 0 and level = 3)")
    rows = rows.select("view", "level", (F.col("id") + F.when((F.col("id") % 83 == 0) & (F.col("level") == 3), 100000000).otherwise(0)).alias("id"))
    return ops.dilution_audit(v, rows, "id", "grp", "split")


@query("""WITH m AS (SELECT p_name AS key, sha256(p_type || ':' || (p_size % 3)) AS d, octet_length(encode(p_type || ':' || (p_size % 3))) AS n FROM part) SELECT key, CAST(count(*) AS BIGINT) AS sources, CASE WHEN min(d) = max(d) THEN min(d) END AS digest, CAST(min(n) AS INTEGER) AS bytes, min(d) <> max(d) AS conflict FROM m GROUP BY key""")
def snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat("p_type", F.lit(":"), (F.col("p_size") % 3).cast("string"))
    return ops.snapshot_index(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), content.alias("content")), "key", "content")


@query("""WITH n AS (SELECT doc_id, lang, sha256(translate(regexp_replace(text, '[ \\t\\n\\v\\f\\r*]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest, quality FROM documents LEFT JOIN labels USING (doc_id)), w AS (SELECT DISTINCT digest FROM n WHERE quality = 1)
SELECT digest, CAST(count(DISTINCT doc_id) AS BIGINT) AS hits, min(doc_id) AS first, max(doc_id) AS last FROM n WHERE lang <> 'de' AND digest IN (SELECT digest FROM w) GROUP BY digest""")
def wanted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("text")
    return ops.wanted_hits(docs, good, "text", "doc_id", F.col("lang") != "de")


@query("""WITH a AS (SELECT l_orderkey AS owner, l_linenumber % 3 AS place, l_discount AS occupancy, CAST(l_partkey AS VARCHAR) AS alt, l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY owner, place ORDER BY occupancy DESC, alt, x, y) AS k FROM a), s AS (SELECT * FROM r WHERE k = 1)
SELECT owner, CAST(place AS INTEGER) AS place, alt, round(x - avg(x) OVER (PARTITION BY owner), 6) AS x, round(y - avg(y) OVER (PARTITION BY owner), 6) AS y FROM s""")
def reduced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") % 3).alias("place"), F.col("l_discount").alias("occupancy"), F.struct(F.col("l_partkey").cast("string").alias("name"), "l_quantity", "l_extendedprice").alias("alt"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    kept = ops.centred(ops.reduced_sites(a, ["owner"], "place", "occupancy", "alt"), ["owner"], ("x", "y"))
    return rounded(kept.select("owner", "place", F.col("alt.name").alias("alt"), "x", "y"))


@query("""WITH c AS (SELECT o_orderkey AS assembly, copy FROM orders, (VALUES (0), (1), (2)) t(copy)), p AS (SELECT l_orderkey AS assembly, CAST(l_suppkey % 3 AS INTEGER) AS copy, l_linenumber % 2 AS site, l_partkey % 5 AS residue FROM lineitem), k AS (SELECT assembly, copy, site, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT residue) >= 2)
SELECT assembly, copy, CAST(count(k.n) AS BIGINT) AS accepted_sites, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS donor_count FROM c LEFT JOIN k USING (assembly, copy) GROUP BY assembly, copy""")
def assembly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assembly"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"))
    partners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assembly"), (F.col("l_suppkey") % 3).cast("int").alias("copy"), (F.col("l_linenumber") % 2).alias("site"), (F.col("l_partkey") % 5).alias("residue"))
    return ops.assembly_summary(copies, partners, "assembly", "copy", "site", "residue", donors=2)


@query("""WITH g AS (SELECT * FROM (VALUES (.5::DOUBLE), (1.5::DOUBLE), (2.5::DOUBLE)) a(cutoff), (VALUES (0::DOUBLE), (.04::DOUBLE)) b(least)), s AS (SELECT cutoff, least, l_orderkey, count(*) AS n FROM lineitem, g WHERE l_quantity / 20 <= cutoff AND l_tax >= least GROUP BY ALL)
SELECT cutoff, least, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS sites, CAST(sum(n) AS BIGINT) AS partners FROM s GROUP BY ALL""")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 20).alias("d"), "l_tax")
    return ops.sensitivity_grid(li, ["l_orderkey"], "d", "l_tax", [0.5, 1.5, 2.5], [0.0, 0.04], 2)


@query("""WITH g AS (SELECT l_orderkey AS owner, l_linenumber AS point, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity / 5 END AS donor, CASE WHEN l_linestatus = 'O' THEN l_discount * 60 END AS centre FROM lineitem), x AS (SELECT *, CASE WHEN donor IS NULL THEN centre WHEN centre IS NULL THEN donor ELSE least(donor, centre) END AS gap FROM g)
SELECT owner, CAST(point AS INTEGER) AS point, round(gap, 6) AS gap, CASE WHEN gap IS NULL OR gap >= 6 THEN 0 WHEN gap <= 3 THEN 1 END AS hard, round(CASE WHEN gap IS NULL THEN 0 ELSE least(1, greatest(0, (6 - gap) / 3)) END, 6) AS soft, NOT (gap > 3 AND gap < 6) OR gap IS NULL AS valid,
round(CASE WHEN gap IS NULL THEN 0 ELSE ((gap <= 3)::INT + (gap <= 4)::INT + (gap <= 5)::INT) / 3.0::DOUBLE END, 6) AS sensitivity FROM x""")
def metal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    gaps = li.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("point"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 5).alias("donor"), F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 60).alias("centre"))
    return rounded(ops.metal_targets(gaps, "donor", "centre", 3.0, 6.0, [3.0, 4.0, 5.0]).select("owner", "point", "gap", "hard", "soft", "valid", "sensitivity"))


@query("""WITH o AS (SELECT o_orderkey AS site, o_custkey AS donors, o_orderpriority AS tier, o_orderstatus AS support FROM orders WHERE o_orderkey % 53 <> 0), e AS (SELECT o_orderkey AS site, CASE WHEN o_orderkey % 2 = 0 THEN '2.0' ELSE '1.0' END AS schema, o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS donors, o_orderpriority AS tier, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS support FROM orders WHERE o_orderkey % 59 <> 0),
j AS (SELECT site, CASE WHEN e.schema IS NULL THEN 'unexpected' WHEN o.donors IS NULL THEN 'missing' WHEN o.donors IS DISTINCT FROM e.donors OR o.tier IS DISTINCT FROM e.tier OR (e.schema = '2.0' AND o.support IS DISTINCT FROM e.support) THEN 'differs' END AS fault FROM o FULL JOIN e USING (site)) SELECT * FROM j WHERE fault IS NOT NULL""")
def site_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    observed = o.filter(k % 53 != 0).select(k.alias("site"), F.col("o_custkey").alias("donors"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("support"))
    expected = o.filter(k % 59 != 0).select(k.alias("site"), F.when(k % 2 == 0, "2.0").otherwise("1.0").alias("schema"), (F.col("o_custkey") + F.when(k % 19 == 0, 1).otherwise(0)).alias("donors"), F.col("o_orderpriority").alias("tier"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("support"))
    return ops.site_differences(observed, expected, ["site"], ["donors", "tier"], ["support"])


@query("""WITH c AS (SELECT p_name AS s, min(p_partkey) AS chain, count(DISTINCT p_partkey) AS n FROM part WHERE length(p_name) > 0 GROUP BY 1), x AS (SELECT l_orderkey * 10 + l_linenumber AS subject, CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN p_name || 'x' ELSE p_name END AS s FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT subject, CASE WHEN s = '' THEN 'empty' WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status, CASE WHEN s <> '' THEN chain END AS chain FROM x LEFT JOIN c USING (s)""")
def mapped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sequence"))
    li = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    s = F.when(F.col("l_partkey") % 13 == 0, "").when(F.col("l_partkey") % 17 == 0, F.concat("sequence", F.lit("x"))).otherwise(F.col("sequence"))
    return ops.mapped_subjects(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject"), s.alias("sequence")), p.select(F.col("p_partkey").alias("chain"), "sequence"), "subject", "chain", "sequence")


FLAGS = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, count(*) FILTER (l_returnflag = 'R') AS contacts, count(*) FILTER (l_discount = 0.1 AND l_tax = 0) AS errors, count(*) FILTER (l_quantity > 10) AS candidates FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"""WITH f AS ({FLAGS}), r AS (SELECT id, CASE WHEN label = 0 AND contacts > 0 THEN 'negative_label_conflict' WHEN label = 0 AND errors > 0 THEN 'negative_incomplete_audit' WHEN label = 0 AND candidates = 0 THEN 'negative_without_structure' WHEN label = 0 THEN 'accepted_negative'
WHEN contacts > 0 THEN 'accepted_positive' WHEN errors > 0 THEN 'positive_incomplete_audit' ELSE 'positive_without_contact' END AS reason FROM f) SELECT id, CASE WHEN reason LIKE 'accepted%' THEN 'accepted' ELSE 'rejected' END AS decision, reason FROM r""")
def core_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("contacts"), F.count_if((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0)).alias("errors"), F.count_if(F.col("l_quantity") > 10).alias("candidates"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label")).join(li, F.col("id") == F.col("l_orderkey"), "left")
    return ops.core_decisions(o.fillna(0, ["contacts", "errors", "candidates"]), "id")


@query("""WITH s AS (SELECT p_type || p_brand AS s, min(p_size % 2) <> max(p_size % 2) AS c FROM part GROUP BY 1) SELECT p_partkey AS id, NOT c AS eligible FROM part JOIN s ON s = p_type || p_brand""")
def ineligible_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_type", "p_brand").alias("sequence"), (F.col("p_size") % 2).alias("label"))
    return ops.contradictory(p, "sequence", "label").select("id", "eligible")


@query("SELECT event_id FROM events WHERE value >= 5 AND value <= 60 AND event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def structured_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    keep = (F.col("value") >= 5) & (F.col("value") <= 60) & (F.col("event_type") == "purchase") & (F.col("k") >= 50)
    return ops.structured_page(e, keep, "event_id", e.filter(keep).count())


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS owner, l_linenumber % 3 AS residue, 'C' || (l_partkey % 4) AS atom FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS owner, l_linenumber % 3 AS residue, CASE WHEN l_suppkey % 7 = 0 THEN 'OXT' ELSE 'C' || (l_partkey % 4) END AS atom FROM lineitem UNION SELECT * FROM o WHERE owner % 3 = 0),
j AS (SELECT owner, residue, atom, o.owner IS NULL AS new, p.owner IS NULL AS gone FROM o FULL JOIN p USING (owner, residue, atom)), a AS (SELECT owner, count(*) FILTER (gone) AS missing, count(*) FILTER (new) AS rebuilt, count(*) FILTER (NOT new) AS observed, count(DISTINCT CASE WHEN new THEN residue END) AS affected, count(DISTINCT CASE WHEN NOT new THEN residue END) AS residues, count(*) FILTER (new AND atom <> 'OXT') AS inside FROM j GROUP BY owner)
SELECT owner, CAST(missing AS BIGINT) AS missing, CAST(rebuilt AS BIGINT) AS rebuilt, CAST(affected AS BIGINT) AS affected, round(rebuilt / nullif(CAST(observed AS DOUBLE), 0), 6) AS rebuilt_share, round(affected / nullif(CAST(residues AS DOUBLE), 0), 6) AS affected_share, CASE WHEN rebuilt = 0 THEN 'observed_only' WHEN inside = 0 THEN 'terminal_oxygen_only' ELSE 'sidechain_completion' END AS category FROM a""")
def reconstruction_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("C"), (F.col("l_partkey") % 4).cast("string"))
    base = li.select(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") % 3).alias("residue"), name.alias("atom"))
    made = li.select(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") % 3).alias("residue"), F.when(F.col("l_suppkey") % 7 == 0, "OXT").otherwise(name).alias("atom")).unionByName(base.filter("owner % 3 = 0"))
    return rounded(ops.reconstruction(base, made, ["owner"], "residue", "atom"))


@query(f"""WITH {ATOMS}, w AS (SELECT owner, sqrt((x - lag(y) OVER o) * (x - lag(y) OVER o) + (y - lag(z) OVER o) * (y - lag(z) OVER o) + (z - lag(x) OVER o) * (z - lag(x) OVER o)) AS d FROM atoms WINDOW o AS (PARTITION BY owner ORDER BY atom)) SELECT owner, CAST(count(d) AS BIGINT) AS links, CAST(count(*) FILTER (d < .9 OR d > 1.9) AS BIGINT) AS broken, round(max(d), 6) AS longest FROM w GROUP BY owner""")
def backbone_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.backbone_gaps(atoms(spark, sf_dir), ["owner"], "atom", ("x", "y", "z"), ("y", "z", "x")))


@query("""WITH c AS (SELECT o_orderkey AS chain, p AS place, substr('ACDEFGHIKL', 1 + CAST((o_orderkey + p) % 10 AS INTEGER), 1) AS token FROM orders, range(1, 8) r(p)), o AS (SELECT l_orderkey AS chain, l_linenumber AS place, substr('ACDEFGHIKL', 1 + CAST((l_orderkey + l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER), 1) AS token FROM lineitem)
SELECT chain, CAST(place AS INTEGER) AS place, c.token AS complete, coalesce(o.token, '-') AS observed, coalesce(o.token <> c.token, false) AS mismatch FROM c LEFT JOIN o USING (chain, place)""")
def sequence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda x: F.substring(F.lit("ACDEFGHIKL"), (x % 10 + 1).cast("int"), F.lit(1))
    complete = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("place")).withColumn("token", letter(F.col("chain") + F.col("place")))
    observed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").cast("int").alias("place"), letter(F.col("l_orderkey") + F.col("l_linenumber") + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)).alias("token"))
    return ops.sequence_context(observed, complete, "chain", "place", "token")


@query("""WITH m AS (SELECT s_nationkey AS member, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT member, coalesce(sum(n) OVER (ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m), l AS (SELECT s_suppkey AS id, s_nationkey AS member, CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE s_suppkey % 4 END AS i FROM supplier) SELECT id, member, i, CAST(CASE WHEN i < 0 THEN -1 ELSE o + i END AS BIGINT) AS place FROM l JOIN b USING (member)""")
def global_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    local = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("member"), F.when(F.col("s_suppkey") % 9 == 0, -1).otherwise(F.col("s_suppkey") % 4).alias("i"))
    return ops.global_places(local, s.groupBy(F.col("s_nationkey").alias("member")).agg(F.count("*").alias("n")), "member", "i", "n").select("id", "member", "i", "place")
