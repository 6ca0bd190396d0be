"""Distributions, strata and comparisons between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.scalar import pearson, ratio


def distribution(value: str, prefix: str = "") -> list[Column]:
    """Aggregates: n, min, mean, population sd, median, quartiles (linear interpolation), max."""
    q = lambda p: F.percentile(F.col(value).cast("double"), F.lit(p))
    return [
        F.count(value).alias(f"{prefix}n"), F.min(value).cast("double").alias(f"{prefix}min"), F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}sd"),
        q(0.5).alias(f"{prefix}median"), q(0.25).alias(f"{prefix}q25"), q(0.75).alias(f"{prefix}q75"), F.max(value).cast("double").alias(f"{prefix}max"),
    ]


def quartile_strata(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds quartile 1..4: boundaries by linear interpolation, a value on a boundary goes below it, ties stay together."""
    cuts = df.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    joined = df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))  # one row
    v = F.col(value)
    return joined.withColumn("quartile", F.when(v <= F.col("cuts")[0], 1).when(v <= F.col("cuts")[1], 2).when(v <= F.col("cuts")[2], 3).otherwise(4)).drop("cuts")


def standardized_difference(df: DataFrame, value: str, side: Column, sample: bool = False) -> list[Column]:
    """Aggregate: (mean of side - mean of the rest) / pooled sd. Population variances, or sample ones with support of 2 on each side."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    var = F.var_samp if sample else F.var_pop
    return [ratio(F.avg(a) - F.avg(b), F.sqrt((var(a) + var(b)) / 2)).alias("smd"), F.count(a).alias("n_side"), F.count(b).alias("n_rest")]


def wasserstein(df: DataFrame, value: str, side: Column, by: Sequence[str] = ()) -> DataFrame:
    """1-D distance between a side and the rest: the area between their distribution functions, from counts per distinct value."""
    levels = df.groupBy(*by, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    w = Window.partitionBy(*by)
    up = w.orderBy(value)
    run = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = levels.withColumn("gap", F.abs(F.sum("a").over(run) / F.sum("a").over(w) - F.sum("b").over(run) / F.sum("b").over(w)) * (F.lead(value).over(up) - F.col(value)))
    return steps.groupBy(*by).agg(F.sum("gap").alias("distance"))


def subgroup_scores(df: DataFrame, stratum: str, least: int = 8) -> DataFrame:
    """0.70 * AP + 0.30 * AUROC of each stratum with enough members, NULL where a part is undefined."""
    from bagweave.operators.bags import auroc, average_precision

    a = average_precision(df, [stratum]).join(auroc(df, [stratum]), stratum).filter(F.col("n") >= least)
    return a.select(stratum, F.col("n").alias("members"), (0.7 * F.col("ap") + 0.3 * F.col("auroc")).alias("score"))


def regression_metrics(df: DataFrame, predicted: str, actual: str, region: str, band: float = 0.1) -> DataFrame:
    """mae, rmse, Pearson and sign accuracy outside a band, per region and overall (region NULL), by grouping sets."""
    p, a = F.col(predicted), F.col(actual)
    rows = df.select(region, p.alias("p"), a.alias("a"), (p - a).alias("e"))
    return rows.rollup(region).agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), pearson("p", "a").alias("pearson"),
        F.avg(F.when(F.abs("a") > band, (F.signum("p") == F.signum("a")).cast("double"))).alias("sign_accuracy"),
    )


def fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of their group's quartiles."""
    q = df.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    return df.join(q, list(by)).filter((F.col(value) < F.col("q")[0] - 1.5 * spread) | (F.col(value) > F.col("q")[1] + 1.5 * spread)).drop("q")


def funnel(stages: DataFrame, order: str, unit: str, count: str) -> DataFrame:
    """Retained share against the stage before, only between equal units."""
    w = Window.orderBy(order)  # a handful of rows, one per stage
    return stages.withColumn("retained", F.when(F.lag(unit).over(w) == F.col(unit), ratio(F.col(count), F.lag(count).over(w))))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency counts; 1 where both are trivial."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    cell = df.groupBy(a, b).agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("both"))
    left = df.groupBy(a).agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("left"), F.sum("n").alias("total"))
    right = df.groupBy(b).agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("right"))
    one = cell.crossJoin(left).crossJoin(right)  # one row each
    expect = F.col("left") * F.col("right") / pairs("total")
    top = (F.col("left") + F.col("right")) / 2
    return one.select(F.coalesce(ratio(F.col("both") - expect, top - expect), F.lit(1.0)).alias("ari"))


def fit_moments(df: DataFrame, values: str, weight: Column | None = None) -> DataFrame:
    """Per channel of an array column: weighted mean, population sd, zeros, min, max."""
    rows = df.select((F.lit(1.0) if weight is None else weight).alias("w"), F.posexplode(values).alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    a = rows.groupBy("channel").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("ss"), F.count_if(F.col("v") == 0).alias("zeros"), F.min("v").alias("min"), F.max("v").alias("max"))
    mean = F.col("s") / F.col("w")
    return a.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("w") - mean * mean)).alias("sd"), "zeros", "min", "max")


def normalized(df: DataFrame, values: str, moments: DataFrame, key: str, epsilon: float = 1e-6) -> DataFrame:
    """(v - mean) / (sd + epsilon) per channel in long form: key, channel, z. The moments are one row per channel."""
    rows = df.select(key, F.posexplode(values).alias("channel", "v"))
    return rows.join(moments.select("channel", "mean", "sd"), "channel").select(key, "channel", ((F.col("v") - F.col("mean")) / (F.col("sd") + epsilon)).alias("z"))


def correlations(df: DataFrame, values: str, channels: int) -> DataFrame:
    """Pearson correlations of the first channels of an array column, one aggregate for all pairs: a, b, r."""
    cells = [(i, j) for i in range(channels) for j in range(i + 1, channels)]
    one = df.agg(*(pearson(F.col(values)[i].cast("double"), F.col(values)[j].cast("double")).alias(f"c{i}_{j}") for i, j in cells))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"c{i}_{j}").alias("r")) for i, j in cells))).alias("x")).select("x.*")
