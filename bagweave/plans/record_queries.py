"""Record, scan, allocation, clustering and publication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.operators import allocation, audits, clustering, descriptors
from bagweave.plans.registry import query
from bagweave.plans.views import table
from bagweave.sources import records, sinks

SEQ = "upper(regexp_replace(p_name, '[^a-z]', '', 'g'))"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("s", F.upper(F.regexp_replace("p_name", "[^a-z]", "")))


@query(f"""WITH r AS (SELECT 'P' || (p_partkey % 1900) || '_' || lower(replace(p_brand, '#', '_')) AS identifier, {SEQ} AS sequence, p_size % 3 AS label, p_partkey % 50 AS protein_copy, CASE WHEN p_partkey % 40 = 0 THEN '2.0' WHEN p_partkey % 2 = 0 THEN '1.0' END AS v FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY identifier) AS n FROM r)
SELECT identifier, split_part(identifier, '_', 1) AS pdb_id, substr(identifier, strpos(identifier, '_') + 1) AS protein_chain, sha256(sequence) AS sequence_sha256, CASE WHEN n > 1 THEN 'duplicate' WHEN NOT regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWYOU]+') THEN 'sequence' WHEN label NOT IN (0, 1) THEN 'label' WHEN protein_copy < 1 THEN 'protein_copy' WHEN v <> '1.0' THEN 'schema_version' END AS reject FROM c""")
def evidence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sequences(spark, sf_dir)
    raw = p.select(
        F.when(F.col("p_partkey") % 40 == 0, "2.0").when(F.col("p_partkey") % 2 == 0, "1.0").alias("schema_version"), F.concat(F.lit("P"), (F.col("p_partkey") % 1900).cast("string"), F.lit("_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("identifier"),
        F.lower("s").alias("sequence"), (F.col("p_size") % 3).alias("label"), (F.col("p_partkey") % 50).cast("int").alias("protein_copy"), F.array(F.lit("b"), F.lit("a")).alias("header_flags"),
    )
    return records.checked_evidence(raw).select("identifier", "pdb_id", "protein_chain", "sequence_sha256", "reject")


@query("""WITH e AS (SELECT user_id % 60 AS id, CASE WHEN value > 60 THEN 1 ELSE 0 END AS l, event_type = 'purchase' AND event_id % 50 = 0 AS v FROM events), a AS (SELECT id, count(*) AS n, max(CASE WHEN v THEN l END) AS hi, min(CASE WHEN v THEN l END) AS lo, min(l) AS a FROM e GROUP BY id)
SELECT id, CAST(n AS BIGINT) AS n, coalesce(hi <> lo, false) AS conflict, coalesce(lo, a) AS l FROM a""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("id"), (F.col("value") > 60).cast("int").alias("l"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)).alias("v"))
    return records.merged_evidence(e, "id", "l", "v")


GROUPS = {"hydrophobic": "AVILMFWY", "polar": "STNQCY", "charged": "DEKRH", "aromatic": "FWY"}
SHARE = "(length(s) - length(translate(s, '{x}', ''))) / CAST(length(s) AS DOUBLE)"


@query(f"""WITH q AS (SELECT p_partkey, {SEQ} AS s FROM part) SELECT p_partkey, length(s) AS length, {", ".join(f"round({SHARE.format(x=v)}, 6) AS {k}" for k, v in GROUPS.items())},
round(list_sum(list_transform(list_filter(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda c: (length(s) - length(replace(s, c, ''))) / CAST(length(s) AS DOUBLE)), lambda f: f > 0), lambda f: -f * log2(f))), 6) AS entropy FROM q""")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = descriptors.sequence_features(sequences(spark, sf_dir), "s")
    return f.select("p_partkey", F.col("length").cast("long").alias("length"), *(F.round(g, 6).alias(g) for g in (*GROUPS, "entropy")))


@query("""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id || '|label=' || (doc_id % 2) || '|x' WHEN doc_id % 3 = 1 THEN 'd' || doc_id || ' Label: ' || (doc_id % 2) ELSE 'd' || doc_id END AS header FROM documents)
SELECT doc_id, coalesce(CAST(nullif(regexp_extract(header, '\\|label=([01])(?:\\||$)', 1), '') AS INTEGER), CAST(nullif(regexp_extract(header, '(?i)label[ :=]+([01])', 1), '') AS INTEGER)) AS label FROM h""")
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = lambda *a: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in a))
    h = F.when(i % 3 == 0, text("d", i.cast("string"), "|label=", (i % 2).cast("string"), "|x")).when(i % 3 == 1, text("d", i.cast("string"), " Label: ", (i % 2).cast("string"))).otherwise(text("d", i.cast("string")))
    return d.select("doc_id", records.header_label(h).alias("label"))


@query("""WITH r AS (SELECT doc_id * 2 AS id, quality AS l FROM labels), c AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS l FROM documents) SELECT r.id, r.l, CASE WHEN c.id IS NULL THEN 'absent' WHEN r.l IS DISTINCT FROM c.l THEN 'mismatch' END AS finding FROM r LEFT JOIN c ON r.id = c.id""")
def labelled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("id"), F.col("quality").alias("l"))
    catalog = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, 0).otherwise(1).alias("l"))
    return records.labelled_members(rows, catalog, "id", "l")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS local_phenotype FROM events")
def catalog_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("j"), F.col("event_type").alias("interface_phenotype"))
    return e.select("event_id", "j.k", "interface_phenotype").withColumnRenamed("interface_phenotype", "local_phenotype")


VIEWS = "SELECT doc_id, 'ten' AS view FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'half' FROM documents WHERE doc_id % 2 = 0"


@query(f"""WITH v AS ({VIEWS}), m AS (SELECT doc_id, list_sort(list(DISTINCT view)) AS d FROM v GROUP BY 1), a AS (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split, coalesce(d, []) AS d FROM documents LEFT JOIN m USING (doc_id))
SELECT doc_id, split, array_to_string(list_filter(d, lambda x: x = 'ten'), ',') AS dilutions FROM a WHERE (split = 'train' AND list_contains(d, 'ten')) OR split = 'validation'""")
def split_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select("doc_id", F.when(i % 5 < 3, "train").when(i % 5 == 3, "validation").otherwise("test").alias("split"))
    views = d.filter(i % 10 == 0).select("doc_id", F.lit("ten").alias("view")).unionAll(d.filter(i % 2 == 0).select("doc_id", F.lit("half").alias("view")))
    out = descriptors.membership_filter(sinks.preprocessing_view(rows, views, "doc_id"), "split", "dilutions", ["ten"], False, True, False)
    return out.withColumn("dilutions", F.array_join("dilutions", ","))


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'negative_balance' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 2000 THEN 'segment' WHEN c_nationkey >= 20 THEN 'nation' END AS reason, lower(regexp_replace(c_mktsegment || ' #' || c_nationkey, '[^A-Za-z0-9]+', '_', 'g')) AS metric FROM customer")
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagweave.functions.scalar import metric_name

    c = table(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    rules = {"unknown": b.isNull(), "negative_balance": b < 0, "segment": (F.col("c_mktsegment") == "MACHINERY") & (b < 2000), "nation": F.col("c_nationkey") >= 20}
    return c.select("c_custkey", descriptors.first_reason(rules).alias("reason"), metric_name(F.concat("c_mktsegment", F.lit(" #"), F.col("c_nationkey").cast("string"))).alias("metric"))


@query("""SELECT l_orderkey, round(CAST(count(DISTINCT CASE WHEN l_linenumber BETWEEN 1 AND 5 THEN l_linenumber END) AS DOUBLE) / 5, 6) AS coverage FROM lineitem GROUP BY 1""")
def coordinate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("length", F.lit(5))
    return descriptors.coverage(li, ["l_orderkey"], "l_linenumber", "length").withColumn("coverage", F.round("coverage", 6))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, -l_quantity, l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) SELECT r.l_orderkey, l_partkey, l_suppkey, supports FROM r JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS supports FROM lineitem GROUP BY 1) s ON r.l_orderkey = s.l_orderkey WHERE r = 1""")
def candidate_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("l_returnflag"), -F.col("l_quantity"), *(F.col(c) for c in ("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"))]
    b = descriptors.best_candidates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "l_linestatus")
    return b.select("l_orderkey", "l_partkey", "l_suppkey", F.array_join("supports", ",").alias("supports"))


@query("""WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) SELECT m.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'success' ELSE 'failure' END AS status FROM m LEFT JOIN labels l ON l.doc_id = m.doc_id""")
def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("failure").alias("state"))
    return sinks.processing_report(table(spark, sf_dir, "documents").select("doc_id"), r, "doc_id", "state")


@query("""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, toxic FROM labels) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, toxic, CASE WHEN a.doc_id IS NULL THEN 'no row' WHEN b.doc_id IS NULL THEN 'no report' END AS finding FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def member_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.member_index(table(spark, sf_dir, "documents").filter("doc_id % 9 <> 0").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


@query("SELECT o_orderkey % 50 AS entry, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS assemblies FROM orders GROUP BY 1")
def assembly_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit("-"), F.col("o_orderstatus"))
    parts = F.split("key", "-")
    return table(spark, sf_dir, "orders").select(key.alias("key")).groupBy(parts[0].cast("long").alias("entry")).agg(F.array_join(F.array_sort(F.collect_set(parts[1])), ",").alias("assemblies"))


def split_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").withColumn("label", (F.col("c_acctbal") < 0).cast("int")).withColumn("family", F.col("c_custkey") % 180)
    s = allocation.assign_splits(c, "family", {"train": 0.7, "validation": 0.15, "test": 0.15}, {"label": 2.0, "c_mktsegment": 0.25, "c_nationkey": 0.25})
    return c, s


@query()
def greedy_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(spark, sf_dir)[1]


@query("""SELECT name, CAST(failures AS BIGINT) AS failures FROM (VALUES ('unique_ids', 0), ('crossing_groups', 0), ('missing_class', 0), ('not_nested', 0), ('fragmented_groups', 0)) t(name, failures)""")
def greedy_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = split_table(spark, sf_dir)
    n = allocation.nested_subsets(c, "family", ["label", "c_mktsegment"], (0.5, 0.25))
    rows = c.join(s, "family").join(n, "family")
    return audits.design_audit(rows, "c_custkey", "family", "split", "label", {"half": F.col("view_50"), "quarter": F.col("view_25")})


@query()
def nested_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.nested_subsets(split_table(spark, sf_dir)[0], "family", ["label", "c_mktsegment"], (0.75, 0.5, 0.25, 0.1))


@query("""WITH n AS (SELECT count(*) FILTER (c_acctbal < 0) AS pos, count(*) FILTER (c_acctbal >= 0) AS neg FROM customer) SELECT CAST(pos AS BIGINT) AS negatives, CAST(round_even(pos * 1.5, 0) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS repeated FROM n""")
def quota_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("label", (F.col("c_acctbal") >= 0).cast("int"))
    chosen = allocation.quota_population(c, "c_custkey", "label", "c_nationkey", ["c_mktsegment"], 1.5).join(c.select("c_custkey", "label"), "c_custkey")
    return chosen.agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"), (F.count("*") - F.countDistinct("c_custkey")).alias("repeated"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, sha256('7:' || c_custkey) AS h, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) AS r FROM customer), o AS (SELECT *, r <= CASE c_mktsegment WHEN 'MACHINERY' THEN 80 WHEN 'BUILDING' THEN 50 WHEN 'FURNITURE' THEN 40 WHEN 'HOUSEHOLD' THEN 30 ELSE 0 END AS own FROM r)
SELECT c_custkey FROM o ORDER BY own DESC, h, c_custkey LIMIT 200""")
def stratified_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.stratified_sample(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", {"MACHINERY": 0.4, "BUILDING": 0.25, "FURNITURE": 0.2, "HOUSEHOLD": 0.15}, 200)


@query()
def density_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(4)))
    return clustering.phenotypes(descriptors.robust_scaled(e, [f"v{i}" for i in range(4)]), "vec_id", [f"v{i}" for i in range(4)], "G", 8, 4)


@query()
def stable_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the least of three sizes, if those of the others agree with them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)))
    return clustering.stable_phenotypes(e, "vec_id", ["v0", "v1", "v2"], "P", [4, 6, 8], 3, 0.5)[0]


@query()
def diverse_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that the diverse choice takes, preferring those in debt."""
    c = table(spark, sf_dir, "customer").withColumn("debt", F.col("c_acctbal") < 0)
    return allocation.diverse_choice(c, "c_custkey", "c_nationkey", ["c_mktsegment"], 60, preferred="debt")


@query()
def shortcut_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "lang", F.col("quality").cast("double").alias("label"))
    return clustering.shortcut_baseline(d, "label", ["n_chars"], ["lang"], "doc_id % 3 <> 1").select("doc_id", "label", F.round("score", 6).alias("score"))


@query()
def embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clustering.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return p.select("vec_id", F.round(F.col("components")[0], 6).alias("pc1"), F.round(F.col("components")[1], 6).alias("pc2"))
