"""Choosing runs, trials, seeds, thresholds and cases; curves over epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.ranged import ranged_sums
from bagweave.functions.scalar import ratio


def latest_eligible(runs: DataFrame, by: Sequence[str], attempt: str, status: str, wanted: str) -> DataFrame:
    """The latest attempt of each run if it has the wanted status: an older success doesn't stand in for a later failure."""
    last = runs.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(attempt).desc()))).filter("_r = 1").drop("_r")
    return last.filter(F.col(status) == wanted)


def matches(where: Sequence[Mapping[str, object]], parameters: str = "parameters") -> Column:
    """An OR of ANDs over a map column; a list means any of its values; an absent field never matches."""
    out = F.lit(False)
    for clause in where:
        every = F.lit(True)
        for field, value in clause.items():
            values = [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
            every = every & F.map_contains_key(parameters, field) & F.coalesce(F.col(parameters)[field].isin(values), F.lit(False))
        out = out | every
    return out


def pareto(rows: DataFrame, identifier: str, low: str, high: str) -> DataFrame:
    """Rows that no other beats: lower ``low`` and higher ``high`` are better. Equal points stay together.

    A running maximum over sorted distinct points, by ranges, replaces the self join: a point falls if a cheaper one reaches as high, or an equally cheap one higher.
    """
    points = rows.groupBy(F.col(low).alias("_l")).agg(F.max(high).alias("_h"))
    reached = ranged_sums(points, [F.col("_l")], {"_b": F.struct("_h", (-F.col("_l")).alias("_n"))}, how=F.max)  # of equal heights the cheapest
    kept = reached.filter(F.col("_b._n") == -F.col("_l")).select("_l", "_h")
    return rows.join(kept, (F.col(low) == F.col("_l")) & (F.col(high) == F.col("_h"))).drop("_l", "_h")


def top_trials(rows: DataFrame, trial: str, metric: str, k: int) -> DataFrame:
    """The k best trials by the median over seeds, the lower trial on ties."""
    a = rows.groupBy(trial).agg(F.percentile(F.col(metric), F.lit(0.5)).alias("median"), F.avg(metric).alias("mean"), F.count("*").alias("seeds"))
    return a.orderBy(F.col("median").desc(), trial).limit(k)


def seed_choices(rows: DataFrame, trial: str, seed: str, metric: str) -> DataFrame:
    """Per trial: best, worst, lower-median seed, and the representative one (nearest to the mean)."""
    w = Window.partitionBy(trial)
    r = rows.withColumns({"_r": F.row_number().over(w.orderBy(metric, seed)), "_n": F.count("*").over(w), "_mean": F.avg(metric).over(w)})
    return r.groupBy(trial).agg(
        F.max_by(seed, F.struct(F.col(metric), -F.col(seed))).alias("best"), F.min_by(seed, F.struct(metric, seed)).alias("worst"),
        F.max(F.when(F.col("_r") == F.floor((F.col("_n") + 1) / 2), F.col(seed))).alias("median"), F.min_by(seed, F.struct(F.round(F.abs(F.col(metric) - F.col("_mean")), 9), F.col(seed))).alias("representative"),
    )


def round_robin(rows: DataFrame, identifier: str, categories: Mapping[str, tuple[Column, Column]], depth: int, ceiling: int) -> DataFrame:
    """Cases from ranked categories, one of each in turn up to the ceiling of distinct cases; all reasons stay: identifier, place, reasons.

    Each category contributes its first ``depth`` rows (a top-k report).
    """
    out = None
    for i, (name, (condition, order)) in enumerate(categories.items()):
        top = rows.filter(condition).orderBy(order, identifier).limit(depth)
        ranked = top.withColumn("r", F.row_number().over(Window.orderBy(order, identifier))).select(identifier, F.lit(name).alias("reason"), F.struct("r", F.lit(i).alias("c")).alias("turn"))
        out = ranked if out is None else out.unionAll(ranked)
    cases = out.groupBy(identifier).agg(F.min("turn").alias("turn"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return cases.withColumn("place", F.row_number().over(Window.orderBy("turn"))).filter(F.col("place") <= ceiling).select(identifier, "place", "reasons")


def capped_budget(rows: DataFrame, bag: str, score: str, tie: str, per_bag: int, budget: int) -> DataFrame:
    """The best rows, at most per_bag of each bag and budget in all."""
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(bag).orderBy(F.col(score).desc(), tie))).filter(F.col("_r") <= per_bag).drop("_r")
    return own.orderBy(F.col(score).desc(), bag, tie).limit(budget)


def families_first(rows: DataFrame, family: str, score: str, tie: str) -> DataFrame:
    """Adds tier: 1 for the hardest of each family, 2 for the rest."""
    return rows.withColumn("tier", F.when(F.row_number().over(Window.partitionBy(family).orderBy(F.col(score).desc(), tie)) == 1, 1).otherwise(2))


def tail_pvalues(rows: DataFrame, score: str, reserve: DataFrame, reserve_score: str) -> DataFrame:
    """Adds pvalue = (1 + number of reserve scores >= score) / (reserve size + 1), from counts per distinct score and their running sums by ranges."""
    levels = rows.select(F.col(score).alias("s")).distinct().select("s", F.lit(0).alias("n")).unionAll(reserve.groupBy(F.col(reserve_score).alias("s")).agg(F.count("*").cast("int").alias("n")))
    sums = levels.groupBy("s").agg(F.sum("n").alias("n"))
    tail = ranged_sums(sums, [F.col("s").desc()], {"above": F.col("n")}).crossJoin(F.broadcast(sums.agg(F.sum("n").alias("total"))))
    return rows.join(tail.select("s", ((1 + F.col("above")) / (F.col("total") + 1)).alias("pvalue")), F.col(score) == F.col("s")).drop("s")


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of best balanced accuracy; ties go to higher specificity, then to the larger threshold; one above the maximum takes part."""
    levels = rows.groupBy(F.col(score).alias("t")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    above = levels.agg((F.max("t") + 1e-9).alias("t"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    total = levels.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    c = ranged_sums(levels.unionAll(above), [F.col("t").desc()], {"hit": F.col("p"), "all": F.col("n")}).crossJoin(F.broadcast(total))
    recall, spec = ratio(F.col("hit"), F.col("tp")), 1 - ratio(F.col("all") - F.col("hit"), F.col("tn") - F.col("tp"))
    c = c.withColumn("ba", F.round((recall + spec) / 2, 12)).withColumn("spec", F.round(spec, 12))
    return c.agg(F.max_by(F.struct("t", "ba", "spec"), F.struct("ba", "spec", "t")).alias("x")).select(F.col("x.t").alias("threshold"), F.col("x.ba").alias("balanced_accuracy"), F.col("x.spec").alias("specificity"))


def coupling(curves: DataFrame, by: Sequence[str], epoch: str, g: str, s: str, drop: float = 0.3) -> DataFrame:
    """Selection by G of S over epochs: first epoch of the best G, S there, best S, regret, Spearman on the suffix after the first ceil(drop * n) epochs, coupling W.

    C = .70 (1 - min(regret / .20, 1)) + .30 (rho + 1) / 2, an undefined rho counting as 0; W = .35 G + .45 S + .20 C.
    """
    from bagweave.operators.bags import spearman

    w = Window.partitionBy(*by)
    placed = curves.withColumns({"r": F.row_number().over(w.orderBy(epoch)), "n": F.count("*").over(w)})
    rho = spearman(placed.filter(F.col("r") > F.ceil(F.lit(drop) * F.col("n"))), list(by), g, s)
    first = F.struct(F.col(g), -F.col(epoch))
    a = curves.groupBy(*by).agg(F.max_by(epoch, first).alias("chosen"), F.max(g).alias("g"), F.max_by(s, first).alias("s"), F.max(s).alias("best_s"))
    a = a.join(rho, list(by), "left").withColumn("regret", F.col("best_s") - F.col("s"))
    c = 0.7 * (1 - F.least(F.col("regret") / 0.2, F.lit(1.0))) + 0.3 * (F.coalesce("rho", F.lit(0.0)) + 1) / 2
    return a.withColumn("w", 0.35 * F.col("g") + 0.45 * F.col("s") + 0.2 * c)


def pareto_knee(rows: DataFrame, cost: str, value: str) -> DataFrame:
    """The frontier point farthest from the line between the frontier's ends, both axes scaled to 0..1."""
    f = pareto(rows.select(cost, value).distinct(), cost, cost, value)
    box = f.agg(F.min(cost).alias("c0"), F.max(cost).alias("c1"), F.min(value).alias("v0"), F.max(value).alias("v1"))
    d = f.crossJoin(F.broadcast(box)).withColumn("d", F.round(F.try_divide(F.col(value) - F.col("v0"), F.col("v1") - F.col("v0")) - F.try_divide(F.col(cost) - F.col("c0"), F.col("c1") - F.col("c0")), 9))
    return d.agg(F.max_by(F.struct(cost, value), F.struct(F.col("d"), -F.col(cost))).alias("x")).select("x.*")


def moving_average(rows: DataFrame, by: Sequence[str], order: str, value: str, decay: float) -> DataFrame:
    """The exponential average after the last of each group's ordered values: a fold, so a group's values meet in one row."""
    seq = F.array_sort(F.collect_list(F.struct(order, value)))
    a = rows.groupBy(*by).agg(seq.alias("seq"))
    start = F.col("seq")[0][value].cast("double")
    return a.select(*by, F.aggregate(F.slice("seq", 2, F.size("seq")), start, lambda m, x: decay * m + (1 - decay) * x[value]).alias("ema"))


def gated_scan(rows: DataFrame, by: Sequence[str], order: str, gate: str, value: str, reverse: bool = False) -> DataFrame:
    """The last state of h = g * h + (1 - g) * u over a group's order."""
    seq = F.array_sort(F.collect_list(F.struct(order, gate, value)))
    a = rows.groupBy(*by).agg((F.reverse(seq) if reverse else seq).alias("seq"))
    return a.select(*by, F.aggregate("seq", F.lit(0.0), lambda h, x: x[gate] * h + (1 - x[gate]) * x[value]).alias("state"))


def matching_bias(rows: DataFrame, score: str, prevalence: float, low: float = -30.0, high: float = 30.0, halvings: int = 64, at_once: int = 6) -> float:
    """The bias b at which the mean of sigmoid(score + b) is the prevalence, by bisection over counts per score.

    One aggregate evaluates all points that the next ``at_once`` halvings could ask for.
    """
    levels = rows.groupBy(score).agg(F.count("*").alias("n")).cache()
    parts = 1 << at_once
    try:
        for _ in range(-(-halvings // at_once)):
            step = (high - low) / parts
            points = [low + step * i for i in range(1, parts)]
            grid = rows.sparkSession.createDataFrame([(b,) for b in points], "b double")  # parts - 1 rows
            means = levels.crossJoin(F.broadcast(grid)).groupBy("b").agg((F.sum(F.col("n") / (1 + F.exp(-(F.col(score) + F.col("b"))))) / F.sum("n")).alias("mean"))
            below = means.filter(F.col("mean") < prevalence).count()
            low, high = low + step * below, low + step * (below + 1)
    finally:
        levels.unpersist()
    return (low + high) / 2
