"""Invariants as queries: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def design_audit(members: DataFrame, identifier: str, group: str, split: str, label: str, views: Mapping[str, Column]) -> DataFrame:
    """(name, failures): unique ids, groups inside one split, both classes in each split, views (large first) nested, no group in part of the first view."""
    names = list(views)

    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("name"), F.count("*").alias("failures"))

    first = F.count_if(views[names[0]]) if names else F.count("*")
    nested = [members.filter(views[b] & ~views[a]) for a, b in zip(names[:-1], names[1:], strict=True)]
    loose = nested[0] if nested else members.limit(0)
    for more in nested[1:]:
        loose = loose.unionAll(more)
    return (
        count("unique_ids", members.groupBy(identifier).agg(F.count("*").alias("n")).filter("n > 1"))
        .unionAll(count("crossing_groups", members.groupBy(group).agg(F.countDistinct(split).alias("n")).filter("n > 1")))
        .unionAll(count("missing_class", members.groupBy(split).agg(F.countDistinct(label).alias("n")).filter("n < 2")))
        .unionAll(count("not_nested", loose))
        .unionAll(count("fragmented_groups", members.groupBy(group).agg(first.alias("a"), F.count("*").alias("n")).filter("a > 0 and a < n")))
    )


def differences(expected: DataFrame, found: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys that are missing, unexpected, or differ in a field (NULL equals NULL)."""
    f = found.select(F.col(key).alias("k2"), *(F.col(c).alias(f"{c}_2") for c in fields))
    j = expected.select(F.col(key).alias("k1"), *fields).join(f, F.col("k1") == F.col("k2"), "full")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    finding = F.when(F.col("k1").isNull(), "unexpected").when(F.col("k2").isNull(), "missing").when(~same, "mismatch")
    return j.select(F.coalesce("k1", "k2").alias(key), finding.alias("finding")).filter("finding is not null")


def coverage_gaps(members: DataFrame, phenotype: str, group: str, split: str, splits: Sequence, least: int = 3) -> DataFrame:
    """Phenotypes of enough groups that some split lacks, with the absent splits."""
    a = members.groupBy(phenotype).agg(F.countDistinct(group).alias("groups"), F.collect_set(split).alias("seen"))
    kind = members.schema[split].dataType
    return a.withColumn("absent", F.array_sort(F.array_except(F.array(*(F.lit(s).cast(kind) for s in splits)), "seen"))).filter((F.col("groups") >= least) & (F.size("absent") > 0))


def reserve_violations(reserve: DataFrame, used: DataFrame, identifier: str, label: str) -> DataFrame:
    """Reserve rows that are used elsewhere or aren't negative, with the reasons."""
    u = used.select(F.col(identifier).alias("uid")).distinct()
    j = reserve.join(u, F.col(identifier) == F.col("uid"), "left")
    reasons = F.filter(F.array(F.when(F.col("uid").isNotNull(), "used"), F.when(F.col(label) != 0, "positive")), lambda r: r.isNotNull())
    return j.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def conflicting(rows: DataFrame, key: str, digest: str) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(digest).alias("versions")).filter("versions > 1")
