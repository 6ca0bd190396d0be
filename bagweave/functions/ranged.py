"""Places and running sums over all rows in an order, by ranges: no task sees more than its range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.lineage import cut

PART, BEFORE = "_part", "_before"


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in ranges of the order, with the number of their range; checkpointed, so that ranges stay as they are."""
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(tasks, *order).withColumn(PART, F.spark_partition_id()))


def ranged_places(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 1. The order must tell all rows apart, or ties fall as they come."""
    return ranged_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: F.col("_one")}).drop("_one")


def ranged_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], how=F.sum) -> DataFrame:
    """Adds running sums (or maxima, with how=F.max) up to and with each row in the order.

    Ranges are summed first (one row for each), and each row's sum is that of the ranges before and that of its own range so far.
    """
    rows = ranged(df, order)
    totals = rows.groupBy(PART).agg(*(how(c).alias(n) for n, c in sums.items()))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = totals.select(F.col(PART), *(how(n).over(earlier).alias(f"{BEFORE}_{n}") for n in sums))
    so_far = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({n: how(c).over(so_far) for n, c in sums.items()}).join(F.broadcast(before), PART)
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + b) if how is F.sum else (lambda a, b: F.greatest(a, b))
    return own.withColumns({n: both(F.col(f"{BEFORE}_{n}"), F.col(n)) for n in sums}).drop(PART, *(f"{BEFORE}_{n}" for n in sums))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each share, the interpolated quantile of the values that are not null, as percentile() gives it.

    Values are counted first and placed by ranges, so that no task or buffer holds a group's values.
    """
    levels = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranged_sums(levels, [*map(F.col, by), F.col("_v")], {"_end": F.col("_n")})
    span = placed.groupBy(*by).agg(F.min(F.col("_end") - F.col("_n")).alias("_start"), F.max("_end").alias("_stop"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = placed.join(F.broadcast(span.withColumnsRenamed({c: f"_by_{c}" for c in by})), same).drop(*(f"_by_{c}" for c in by))
    last, end, out = F.col("_stop") - F.col("_start") - 1, F.col("_end") - F.col("_start"), {}
    for name, share in shares.items():
        at = F.lit(share) * last
        # the least value whose place, from 0, is no less than the one asked for
        low, high = (F.min(F.when(end > f(at), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out[name] = low + F.when(part > 0, part * (high - low)).otherwise(0.0)
    return rows.groupBy(*by).agg(*(c.alias(n) for n, c in out.items()))


def dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows by hash of the keys in all of the session's partitions, which are not merged: several sorts of them in one task stay small."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
