"""Scans of evidence, pair tables, manifests and FASTA: explicit schemas, rejects as rows, keys derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

EVIDENCE = "schema_version string, identifier string, sequence string, label int, origin string, source string, label_evidence string, assembly_id string, protein_copy int, header_flags array<string>"
#: Fixed value: the residue alphabet of evidence.
ALPHABET = "^[ACDEFGHIKLMNPQRSTVWYOU]+$"


def checked_evidence(raw: DataFrame) -> DataFrame:
    """Adds pdb_id, protein_chain (split at the first underscore only), sequence_sha256, sorted flags and ``reject``, the first broken rule or NULL."""
    rows = raw.withColumn("sequence", F.upper(F.trim("sequence"))).withColumn("header_flags", F.array_sort(F.coalesce("header_flags", F.array().cast("array<string>"))))
    twice = F.count("*").over(Window.partitionBy("identifier")) > 1
    reject = (
        F.when(F.col("identifier").isNull() | (F.trim("identifier") == ""), "identifier").when(twice, "duplicate").when(~F.coalesce(F.col("sequence").rlike(ALPHABET), F.lit(False)), "sequence")
        .when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label").when(~F.coalesce(F.col("protein_copy") >= 1, F.lit(False)), "protein_copy").when(F.col("schema_version").isNotNull() & (F.col("schema_version") != "1.0"), "schema_version")
    )
    parts = F.split("identifier", "_", 2)
    return rows.withColumns({"pdb_id": parts[0], "protein_chain": F.try_element_at(parts, F.lit(2)), "sequence_sha256": F.sha2("sequence", 256), "reject": reject})


def evidence_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of evidence; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return checked_evidence(lines.select(F.from_json("value", EVIDENCE).alias("r")).select("r.*"))


def merged_evidence(rows: DataFrame, identifier: str, label: str, verified: str) -> DataFrame:
    """One row per identifier: an unverified positive yields to a denial; verified disagreement is a conflict, never relabelled."""
    a = rows.groupBy(identifier).agg(F.count("*").alias("n"), F.max(F.when(F.col(verified), F.col(label))).alias("hi"), F.min(F.when(F.col(verified), F.col(label))).alias("lo"), F.min(label).alias("any"))
    return a.select(identifier, "n", (F.coalesce(F.col("hi") != F.col("lo"), F.lit(False))).alias("conflict"), F.coalesce("lo", "any").alias(label))


def exact_width_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text of exactly these columns; other widths are marked in ``bad_width``."""
    parts = spark.read.text(path).filter("value != ''").select(F.split("value", "\t", -1).alias("p"))
    return parts.select(*(F.try_element_at("p", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)), (F.size("p") != len(columns)).alias("bad_width"))


def labelled_members(rows: DataFrame, catalog: DataFrame, identifier: str, label: str) -> DataFrame:
    """Joins labelled ids to the catalog; finding is absent, mismatch or NULL."""
    c = catalog.select(F.col(identifier).alias("cid"), F.col(label).alias("clabel"))
    j = rows.join(c, F.col(identifier) == F.col("cid"), "left")
    return j.select(identifier, label, F.when(F.col("cid").isNull(), "absent").when(~F.col(label).eqNullSafe(F.col("clabel")), "mismatch").alias("finding"))


def id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a manifest in order of first mention, blanks and # lines dropped; file names made unique: id, place, name."""
    ids = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "id")).withColumn("id", F.trim("id")).filter("id != '' and not startswith(id, '#')")
    first = ids.groupBy("id").agg(F.min("line").alias("line"))
    stem = F.regexp_replace(F.regexp_extract("id", r"([^/]+)$", 1), r"\.[^.]*$", "")
    again = F.row_number().over(Window.partitionBy(stem).orderBy("line"))
    return first.select("id", F.row_number().over(Window.orderBy("line")).alias("place"), F.concat(stem, F.when(again > 1, F.concat(F.lit("_"), again.cast("string"))).otherwise("")).alias("name"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence (upper case, lines joined) of FASTA files; a record is found by its line separator, so files are split."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    lines = F.split(text, "\r?\n")
    return records.select(F.trim(lines[0]).alias("header"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ""), r"\s", "")).alias("sequence")).filter("header != ''")


def header_label(header: F.Column) -> F.Column:
    """The label of a header: a |label=N| field first, then any label:N or label N."""
    empty = lambda c: F.when(c != "", c.cast("int"))
    return F.coalesce(empty(F.regexp_extract(header, r"\|label=([01])(?:\||$)", 1)), empty(F.regexp_extract(header, r"(?i)label[ :=]+([01])", 1)))


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def membership(files: dict[str, tuple[str, str]], spark: SparkSession) -> DataFrame:
    """Unions id files, each with a role and a value, and reports per id the values and whether a role has more than one."""
    out = None
    for path, (role, value) in files.items():
        rows = spark.read.text(path).select(F.trim("value").alias("identifier"), F.lit(role).alias("role"), F.lit(value).alias("value")).filter("identifier != ''")
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("identifier", "role").agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("overlap", F.size("values") > 1)


def evidence_schema() -> T.StructType:
    return T._parse_datatype_string(EVIDENCE)
