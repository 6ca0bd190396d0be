"""Published views: manifests, FASTA, nested CSV, per-split JSON and reports, each through Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_view(rows: DataFrame, identifier: str, label: str | None = None) -> DataFrame:
    """One text column: ids in order, with the label after a tab if one is named."""
    line = F.col(identifier).cast("string") if label is None else F.concat_ws("\t", F.col(identifier).cast("string"), F.col(label).cast("string"))
    return rows.select(F.col(identifier).alias("_id"), line.alias("value")).orderBy("_id").select("value")


def fasta_view(rows: DataFrame, identifier: str, sequence: str, width: int = 60) -> DataFrame:
    wrapped = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    return rows.orderBy(identifier).select(F.concat(F.lit(">"), F.col(identifier).cast("string"), F.lit("\n"), wrapped).alias("value"))


def csv_view(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return rows.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields))


def preprocessing_view(rows: DataFrame, views: DataFrame, identifier: str) -> DataFrame:
    """Rows with ``dilutions``, the sorted names of the views (identifier, view) that hold them."""
    v = views.groupBy(F.col(identifier).alias("_id")).agg(F.array_sort(F.collect_set("view")).alias("dilutions"))
    return rows.join(v, F.col(identifier) == F.col("_id"), "left").drop("_id").withColumn("dilutions", F.coalesce("dilutions", F.array().cast("array<string>")))


def processing_report(manifest: DataFrame, results: DataFrame, identifier: str, status: str) -> DataFrame:
    """The manifest's ids in order with their status; missing where there is no result."""
    r = results.select(F.col(identifier).alias("_id"), F.col(status).alias("status"))
    return manifest.join(r, F.col(identifier) == F.col("_id"), "left").drop("_id").withColumn("status", F.coalesce("status", F.lit("missing")))


def member_index(rows: DataFrame, report: DataFrame, identifier: str) -> DataFrame:
    """Full join of rows and report; ``finding`` names what lacks a partner (NULL for complete members)."""
    r = report.select(F.col(identifier).alias("_id"), *[c for c in report.columns if c != identifier])
    j = rows.join(r, F.col(identifier) == F.col("_id"), "full")
    return j.withColumn("finding", F.when(F.col(identifier).isNull(), "no row").when(F.col("_id").isNull(), "no report")).withColumn(identifier, F.coalesce(identifier, "_id")).drop("_id")


def point_cloud(points: DataFrame, channels: list[str]) -> DataFrame:
    """ASCII point lines, x y z and channels with six decimals, under a PLY header: one text column with its order."""
    head = ["ply", "format ascii 1.0", *(f"property float {c}" for c in ("x", "y", "z", *channels)), "end_header"]
    spark = points.sparkSession
    header = spark.createDataFrame([(-1, i, line) for i, line in enumerate(head)], "part long, place long, value string")
    body = points.select(F.lit(0).cast("long").alias("part"), F.col("point").cast("long").alias("place"), F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in ("x", "y", "z", *channels))).alias("value"))
    return header.unionAll(body)


def publish(rows: DataFrame, path: str, kind: str, audit: DataFrame | None = None, partition: str | None = None) -> None:
    """Writes only if the audit (rows are findings) is empty."""
    if audit is not None and not audit.isEmpty():
        raise ValueError("the audit has findings; nothing is published")
    writer = rows.write.mode("errorifexists")
    writer = writer.partitionBy(partition) if partition else writer
    {"text": writer.text, "json": writer.json, "parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True)}[kind](path)
