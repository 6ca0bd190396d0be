"""File scans and views, each written to the shared folder, read back, compared and taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions.lineage import cut
from bagweave.plans.member_queries import place
from bagweave.plans.registry import query
from bagweave.plans.study_queries import rounded
from bagweave.plans.views import atoms, table
from bagweave.sources import arrays, records, sinks


def through(spark: SparkSession, name: str, files: dict[str, DataFrame], read) -> DataFrame:
    """What read(folder) finds in text files (name: lines) of a fresh folder; checkpointed, then the folder goes."""
    path = place(spark, name)
    for n, lines in files.items():
        lines.write.text(f"{path}/{n}")
    out = cut(read(path))
    arrays.removed(path)
    return out


@query("SELECT o_orderkey AS id, o_orderpriority AS tier, round(o_totalprice, 4) AS size FROM orders")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a line; an old field name gives way to the new one."""
    o = table(spark, sf_dir, "orders")
    old = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("size")))
    new = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tier"), F.col("o_totalprice").alias("size")))
    lines = o.select(F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(new).alias("value"))

    def read(path: str) -> DataFrame:
        r = spark.read.text(f"{path}/m").filter("value != ''").select(F.from_json("value", "id long, tier string, priority string, size double").alias("r")).select("r.*")
        return rounded(r.select("id", F.coalesce("tier", "priority").alias("tier"), "size"), 4)

    return through(spark, "manifest", {"m": lines}, read)


@query("SELECT name AS id, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place FROM (SELECT p_name || '-' || p_brand AS name, min(p_partkey) AS k FROM part GROUP BY 1)")
def id_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids with blanks, comments and repeats: the distinct ones by first mention."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_brand").alias("id"))
    lines = p.select("p_partkey", F.explode(F.array(F.concat(F.lit("  "), "id"), F.lit(""), F.lit("# note"))).alias("value")).orderBy("p_partkey").select("value").coalesce(1)
    return through(spark, "ids", {"m": lines}, lambda path: records.id_manifest(spark, f"{path}/m").select("id", F.col("place").cast("int").alias("place")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS target, CASE WHEN l_suppkey % 10 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS score, l_suppkey % 10 = 0 AS bad_width FROM lineitem")
def exact_width_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    lines = li.select(F.when(F.col("l_suppkey") % 10 > 0, F.concat_ws("\t", *parts)).otherwise(F.concat_ws("\t", *parts[:2])).alias("value"))
    return through(spark, "pairs", {"m": lines}, lambda path: records.exact_width_tsv(spark, f"{path}/m", ["query", "target", "score"]))


@query("SELECT 'part ' || p_partkey AS header, upper(replace(p_name || p_type || p_brand, ' ', '')) AS sequence FROM part")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA written in lines of ten residues and read back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("id"), F.translate(F.concat("p_name", "p_type", "p_brand"), " ", "").alias("sequence"))
    lines = sinks.fasta_view(p.select("id", "sequence"), "id", "sequence", 10)
    return through(spark, "fasta", {"m": lines}, lambda path: records.fasta(spark, f"{path}/m"))


@query("""WITH f AS (SELECT p_partkey AS id, 'label' AS role, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'negative' END AS value FROM part UNION SELECT p_partkey, 'label', 'positive' FROM part WHERE p_size = 7 UNION SELECT p_partkey, 'split', CASE WHEN p_size % 3 = 0 THEN 'test' ELSE 'train' END FROM part)
SELECT CAST(id AS VARCHAR) AS identifier, role, string_agg(value, ',' ORDER BY value) AS roles, count(*) > 1 AS overlap FROM f GROUP BY ALL""")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files against split files, with ids that two files of one role hold."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    ids = lambda c: p.filter(c).select(F.col("p_partkey").cast("string").alias("value"))
    files = {"positive": ids((size % 2 == 0) | (size == 7)), "negative": ids(size % 2 != 0), "test": ids(size % 3 == 0), "train": ids(size % 3 != 0)}

    def read(path: str) -> DataFrame:
        m = records.membership({f"{path}/{n}": ("label" if n.endswith("ive") else "split", n) for n in files}, spark)
        return m.select("identifier", "role", F.array_join("values", ",").alias("roles"), "overlap")

    return through(spark, "membership", files, read)


@query("""SELECT CAST(1 AS BIGINT) AS files, CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS bytes, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS digest FROM part""")
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact bytes of a source file: length and SHA-256."""
    lines = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.col("p_name").alias("value")).coalesce(1)

    def read(path: str) -> DataFrame:
        d = records.content_digests(spark, f"{path}/m/*.txt")
        return d.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.min("sha256").alias("digest"))

    return through(spark, "digest", {"m": lines}, read)


@query("SELECT p_partkey || chr(9) || (p_size % 2) AS line, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS place FROM part")
def labelled_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in order with their labels after a tab."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2).alias("label"))

    def read(path: str) -> DataFrame:
        whole = spark.read.text(f"{path}/m", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).filter("line != ''")
        return whole.select("line", (F.col("at") + 1).cast("int").alias("place"))

    return through(spark, "labelled", {"m": sinks.id_view(p, "p_partkey", "label").coalesce(1)}, read)


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'test' ELSE 'train' END AS split, concat_ws(',', CASE WHEN p_size % 2 = 0 AND p_size % 5 <> 0 THEN 'half' END, CASE WHEN p_size % 4 = 0 AND p_size % 5 <> 0 THEN 'quarter' END) AS dilutions FROM part""")
def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by split with the sorted names of the training views that hold each id."""
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size % 5 == 0, "test").otherwise("train").alias("split"), "p_size")
    train = p.filter("split = 'train'")
    views = train.filter("p_size % 2 = 0").select("id", F.lit("half").alias("view")).unionAll(train.filter("p_size % 4 = 0").select("id", F.lit("quarter").alias("view")))
    rows = sinks.preprocessing_view(p.drop("p_size"), views, "id")
    files = {s: rows.filter(F.col("split") == s).select(F.to_json(F.struct("id", "split", "dilutions")).alias("value")) for s in ("train", "test")}

    def read(path: str) -> DataFrame:
        r = spark.read.text([f"{path}/train", f"{path}/test"]).select(F.from_json("value", "id long, split string, dilutions array<string>").alias("r")).select("r.*")
        return r.select("id", "split", F.array_join("dilutions", ",").alias("dilutions"))

    return through(spark, "records", files, read)


@query("SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_type AS kind FROM part")
def nested_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values as JSON text in CSV, and back."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_brand").alias("brand"), F.array("p_size").alias("sizes")).alias("nested"), F.col("p_type").alias("kind"))
    path = place(spark, "csv")
    sinks.publish(sinks.csv_view(p), path, "csv")
    r = spark.read.csv(path, header=True, schema="id long, nested string, kind string", quote='"', escape="\\").withColumn("n", F.from_json("nested", "brand string, sizes array<int>"))
    out = cut(r.select("id", F.col("n.brand").alias("brand"), F.col("n.sizes")[0].alias("size"), "kind"))
    arrays.removed(path)
    return out


@query("""WITH a AS (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS findings, CAST(count(*) AS BIGINT) AS published FROM orders""")
def audited_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published only after an audit without findings (here: repeated ids)."""
    o, path = table(spark, sf_dir, "orders"), place(spark, "publication")
    audit = o.groupBy("o_orderkey").count().filter("count > 1")
    sinks.publish(o, path, "parquet", audit)
    out = spark.createDataFrame([(audit.count(), spark.read.parquet(path).count())], "findings long, published long")
    arrays.removed(path)
    return out


@query("""SELECT printf('%.6f %.6f %.6f %.6f', round(CAST(embedding[1] AS DOUBLE) * 10, 4), round(CAST(embedding[2] AS DOUBLE) * 10, 4), round(CAST(embedding[3] AS DOUBLE) * 10, 4), CAST((vec_id * 37) % 101 AS DOUBLE) / 100) AS value, vec_id AS place FROM embeddings
UNION ALL SELECT unnest(['ply', 'format ascii 1.0', 'property float x', 'property float y', 'property float z', 'property float p', 'end_header']), unnest([-7, -6, -5, -4, -3, -2, -1])""")
def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sinks.point_cloud(atoms(spark, sf_dir).select(F.col("atom").alias("point"), "x", "y", "z", "p"), ["p"])
    return c.select("value", F.when(F.col("part") < 0, F.col("place") - 7).otherwise(F.col("place")).alias("place"))
