"""Gated reads, validated writes and staged documents of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The headers that old manifests may have, and the names their columns get.
LEGACY_HEADERS = {"id,label,split": ("id", "label", "split"), "identifier,label,split,group": ("id", "label", "split", "group")}


def array_table(df: DataFrame, version: str, required: Sequence[str], optional: dict[str, Column], families: dict[str, Sequence[str]], wanted: Sequence[str]) -> DataFrame:
    """The columns of the wanted families: required ones must be there, optional ones get their default; rows of another schema version are an error when read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required arrays are missing: {missing}")
    unknown = [f for f in wanted if f not in families]
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    gate = F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce("schema_version", F.lit("null")))))
    columns = [c for f in wanted for c in families[f]]
    return df.filter(gate).select(*(F.col(c) if c in df.columns else optional[c].alias(c) for c in dict.fromkeys(columns)))


def managed_index(members: DataFrame, split: str, view: str | None = None) -> DataFrame:
    """Members of a split, of the training split only those of a view if one is named; more than one task among them is an error."""
    chosen = members.filter(F.col("split") == split)
    if view is not None and split == "train":
        chosen = chosen.filter(F.array_contains("views", view))
    tasks = chosen.agg(F.countDistinct("task")).first()[0]
    if tasks > 1:
        raise ValueError(f"{tasks} tasks in one index")
    return chosen


def legacy_manifest(lines: DataFrame, header: str) -> DataFrame:
    """Lines (value) of a manifest whose header is one of the two that exist."""
    if header not in LEGACY_HEADERS:
        raise ValueError(f"not a manifest header: {header!r}")
    names = LEGACY_HEADERS[header]
    row = F.from_csv("value", ", ".join(f"{n} {'int' if n == 'label' else 'string'}" for n in names), {"mode": "FAILFAST"})
    out = lines.filter(F.col("value") != header).select(row.alias("r")).select("r.*")
    return out if "group" in names else out.withColumn("group", F.lit(None).cast("string"))


def frame_digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free digest of them."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def validated_write(df: DataFrame, path: str) -> tuple[int, int]:
    """Writes Parquet beside its place, reads it back, and puts it in place only if rows and digest agree; what stood there stays until then."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.writing"
    df.write.mode("overwrite").parquet(beside)
    told, found = frame_digest(df), frame_digest(spark.read.parquet(beside).select(df.columns))
    store, folder = pafs.FileSystem.from_uri(beside)
    if told != found:
        store.delete_dir(folder)
        raise ValueError(f"{found} read back of {told}")
    place = pafs.FileSystem.from_uri(path)[1]
    if store.get_file_info(place).type == pafs.FileType.Directory:
        store.delete_dir(place)
    store.move(folder, place)
    return found


def removed(path: str) -> None:
    """Takes away what validated_write put at a path, or under it."""
    store, folder = pafs.FileSystem.from_uri(path)
    if store.get_file_info(folder).type == pafs.FileType.Directory:
        store.delete_dir(folder)


def published_design(spark: SparkSession, parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every part (catalog, manifests, edges, groups, audits) under the path and returns what reads back: part, rows."""
    out = []
    for name, df in parts.items():
        n, _ = validated_write(df, f"{path}/{name}")
        out.append((name, n))
    return spark.createDataFrame(out, "part string, rows long")


def receipts(rows: DataFrame, key: str, document: str, fields: dict[str, str]) -> DataFrame:
    """Staged JSON documents with the digest and length of their exact bytes and some fields (name: type); what doesn't parse is kept and told."""
    parsed = F.from_json(document, ", ".join(f"{n} {t}" for n, t in fields.items()))
    return rows.select(key, F.sha2(document, 256).alias("digest"), F.octet_length(document).alias("bytes"), *(parsed[n].alias(n) for n in fields), F.get_json_object(document, "$").isNotNull().alias("parsed"))


def staged_pages(pages: DataFrame, total: str, items: str, schema: str) -> DataFrame:
    """All items of staged pages; a store whose pages hold fewer than announced is an error."""
    rows = pages.select(F.explode(F.from_json(items, f"array<{schema}>")).alias("item")).select("item.*")
    told = pages.agg(F.max(total)).first()[0] or 0
    if (n := rows.count()) != told:
        raise ValueError(f"{n} items of {told} announced")
    return rows


def resolved(requests: DataFrame, names: str, known: Sequence[str], groups: dict[str, Sequence[str]], group: str, exclude: str) -> DataFrame:
    """Adds ``features`` to requests: the group's features (a null group has none), then the named ones (array columns ``names`` and ``exclude``), each
    once in that order, without the excluded ones. An unknown group or feature is an error when read."""
    whole = F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.array(*(F.lit(n) for n in v)))))
    none = F.array().cast("array<string>")
    own = F.when(F.col(group).isNull(), none).otherwise(F.coalesce(F.try_element_at(whole, F.col(group)), F.raise_error(F.concat(F.lit("unknown group: "), group)).cast("array<string>")))
    asked, less = F.concat(own, F.coalesce(names, none)), F.coalesce(exclude, none)
    unknown = F.array_except(F.concat(asked, less), F.array(*(F.lit(n) for n in known)))
    fine = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown features: "), F.array_join(F.array_sort(unknown), ", "))).cast("array<string>")).otherwise(F.array_except(asked, less))
    return requests.withColumn("features", fine)

