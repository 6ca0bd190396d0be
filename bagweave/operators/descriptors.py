"""Descriptors of sequences and records, category tokens, decision tables and candidate ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Residues and their groups.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
RESIDUE_GROUPS = {"hydrophobic": "AVILMFWY", "polar": "STNQCY", "charged": "DEKRH", "aromatic": "FWY"}


def letter_count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def sequence_features(df: DataFrame, sequence: str) -> DataFrame:
    """Adds length, residue fractions (array in alphabet order), group fractions and Shannon entropy in bits; NULL for empty sequences."""
    s = F.col(sequence)
    n = F.when(F.length(s) > 0, F.length(s).cast("double"))
    shares = [letter_count(s, r) / n for r in RESIDUES]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in shares), F.lit(0.0))
    return df.withColumns({"length": F.length(s), "fractions": F.array(*shares), **{g: letter_count(s, letters) / n for g, letters in RESIDUE_GROUPS.items()}, "entropy": F.when(n.isNotNull(), entropy)})


def eligible(value: Column, ceiling: float | None) -> Column:
    """Kept where the ceiling or the value is unknown, or the value is at most the ceiling."""
    return F.lit(True) if ceiling is None else F.coalesce(value <= ceiling, F.lit(True))


def tokens(value: Column, missing: Sequence[str] = ("", "unavailable", "not_applicable")) -> Column:
    """Distinct present strings of a scalar or array column, sorted."""
    return F.array_sort(F.array_distinct(F.filter(value, lambda x: x.isNotNull() & ~x.isin(*missing))))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, NULL for none."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules.items()))


def coverage(df: DataFrame, by: Sequence[str], position: str, length: str) -> DataFrame:
    """Distinct positions in 1..length over length."""
    inside = F.when(F.col(position).between(1, F.col(length)), F.col(position))
    return df.groupBy(*by).agg(F.try_divide(F.countDistinct(inside).cast("double"), F.max(length).cast("double")).alias("coverage"))


def best_candidates(df: DataFrame, by: Sequence[str], order: Sequence[Column], support: str) -> DataFrame:
    """The first candidate of each key by the order, with the sorted set of supports of all."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
    sets = df.groupBy(*(F.col(b).alias(f"_{b}") for b in by)).agg(F.array_sort(F.collect_set(support)).alias("supports"))
    on = [F.col(b) == F.col(f"_{b}") for b in by]
    return first.join(sets, on).drop(*(f"_{b}" for b in by))


def membership_filter(df: DataFrame, split: str, views: str, wanted: Sequence[str], full_train: bool, validation: bool, test: bool) -> DataFrame:
    """Train rows of the wanted views (or all), and validation or test if asked for; the view array is cut to the wanted ones."""
    want = F.array(*(F.lit(w) for w in wanted)).cast("array<string>")
    keep = ((F.col(split) == "train") & (F.lit(full_train) | F.arrays_overlap(views, want))) | ((F.col(split) == "validation") & F.lit(validation)) | ((F.col(split) == "test") & F.lit(test))
    return df.filter(keep).withColumn(views, F.array_sort(F.array_intersect(views, want)))


def robust_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(v - median) / interquartile range per column, missing values at the median; constant columns are dropped."""
    q = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns)).first()
    kept = [c for c in columns if q[c] is not None and q[c][2] > q[c][0]]
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(q[c][1])) - q[c][1]) / (q[c][2] - q[c][0]) for c in kept}).drop(*(c for c in columns if c not in kept))


def unexplained_sites(sites: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes that match no site of their keys; the guard of the two-key join."""
    return notes.join(sites.select(*keys).distinct(), list(keys), "left_anti")
