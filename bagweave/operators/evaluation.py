"""Evaluation of decisions, views, heads and concept codes. Undefined results are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagweave.functions.lineage import cut
from bagweave.functions.ranged import ranged_sums
from bagweave.functions.scalar import pearson, ratio, sigmoid


def decision_metrics(df: DataFrame, by: list[str], prediction: str, target: str) -> DataFrame:
    """Seven metrics of boolean decisions, each NULL where its denominator vanishes; what ranks is left alone."""
    said, real = F.col(prediction), F.col(target) == 1
    c = df.groupBy(*by).agg(F.count_if(said & real).alias("tp"), F.count_if(said & ~real).alias("fp"), F.count_if(~said & ~real).alias("tn"), F.count_if(~said & real).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        *by, ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        specificity.alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"),
    )


def validation_utility(ap: Column, auroc: Column) -> Column:
    """0.7 of average precision and 0.3 of the area under the curve within 0 and 1; NULL if either is."""
    return F.when(ap.isNotNull() & auroc.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * ap + 0.3 * auroc)))


def checkpoint_records(curve: DataFrame, by: list[str], epoch: str, score: str, carried: list[str]) -> DataFrame:
    """The curve's row of the best score (the first of ties), with the number of epochs seen and the score of the last one."""
    best = F.max_by(F.struct(epoch, *carried), F.struct(F.col(score), -F.col(epoch)))
    a = curve.filter(F.col(score).isNotNull()).groupBy(*by).agg(best.alias("b"), F.max(score).alias("best"), F.max_by(score, epoch).alias("last"), F.count("*").alias("epochs"))
    return a.select(*by, F.col(f"b.{epoch}").alias("epoch"), *(F.col(f"b.{c}").alias(c) for c in carried), "best", "last", "epochs")


def fit_scaler(df: DataFrame, vector: str, epsilon: float = 1e-6) -> DataFrame:
    """dim, mean, scale: population deviation of each dimension of the training vectors, at least epsilon."""
    return df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.greatest(F.stddev_pop(F.col("v").cast("double")), F.lit(epsilon)).alias("scale"))


def standardized(df: DataFrame, key: str, vector: str, scaler: DataFrame) -> DataFrame:
    """key, dim, z = (v - mean) / scale; the scaler has one row for each dimension."""
    return df.select(key, F.posexplode(vector).alias("dim", "v")).join(scaler, "dim").select(key, "dim", ((F.col("v").cast("double") - F.col("mean")) / F.col("scale")).alias("z"))


def code_fidelity(df: DataFrame, owner: str, original: str, rebuilt: str) -> DataFrame:
    """One row: how far rebuilt logits keep the original ones, point by point and by the maximum of each owner."""
    a, b = F.col(original), F.col(rebuilt)
    points = df.agg(F.avg((b - a) * (b - a)).alias("mse"), F.var_pop(a).alias("variance"), pearson(a, b).alias("pearson"), F.count("*").alias("points"))
    bags = df.groupBy(owner).agg(F.max(a).alias("a"), F.max(b).alias("b"))
    whole = bags.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("bag_mae"), pearson("a", "b").alias("bag_pearson"), F.avg(F.abs(sigmoid(F.col("a")) - sigmoid(F.col("b")))).alias("bag_probability_mae"), F.count("*").alias("bags"))
    r2 = F.when(F.col("variance") > 1e-8, 1 - F.col("mse") / F.col("variance"))
    return points.crossJoin(whole).select("mse", "pearson", r2.alias("r2"), "points", "bag_mae", "bag_pearson", "bag_probability_mae", "bags", (F.col("mse") / F.greatest("variance", F.lit(1e-8)) + F.col("bag_probability_mae")).alias("selection_error"))


def activation_rates(codes: DataFrame, unit: str, value: str) -> DataFrame:
    """unit, rate of positive values, dead if there are none."""
    return codes.groupBy(unit).agg(F.avg((F.col(value) > 0).cast("double")).alias("rate")).withColumn("dead", F.col("rate") == 0)


def global_reductions(df: DataFrame, by: list[str], value: str, area: str) -> DataFrame:
    """Mean, area mean, area sum and maximum of a state over its owner's points."""
    v, w = F.col(value), F.col(area)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), ratio(F.sum(v * w), F.sum(w)).alias("area_mean"), F.sum(v * w).alias("area_sum"), F.max(v).alias("max"))


def map_comparison(aligned: DataFrame, by: list[str], first: str, second: str, area: str, valid: str, shares: tuple[float, ...] = (0.05, 0.1), tie: str = "point") -> DataFrame:
    """A destination's map against another one brought onto it: coverage by area and points, area-weighted errors of
    logits and probabilities, rank correlation, and the overlap of the top shares of the supported area."""
    seen, a, b, w = F.col(valid), F.col(first), F.col(second), F.when(F.col(valid), F.col(area))
    weighted = lambda x: ratio(F.sum(w * x), F.sum(w))
    pa, pb = sigmoid(a), F.col("second_p")
    out = aligned.groupBy(*by).agg(
        ratio(F.sum(w), F.sum(area)).alias("coverage"), F.count_if(seen).alias("supported"), weighted(F.abs(a - b)).alias("logit_mae"), F.sqrt(weighted((a - b) * (a - b))).alias("logit_rmse"),
        weighted(F.abs(pa - pb)).alias("probability_mae"), F.sqrt(weighted((pa - pb) * (pa - pb))).alias("probability_rmse"),
    )
    kept = aligned.filter(seen)
    out = out.join(rank_correlation(kept, by, first, second), by, "left").withColumnRenamed("rho", "spearman")
    names = {round(100 * share): share for share in shares}
    cuts = {side: area_cuts(kept, by, column, area, names, tie) for side, column in (("l", first), ("r", second))}
    for name in names:
        rows, mass = kept, {}
        for side, column in (("l", first), ("r", second)):
            at = cuts[side].filter(F.col("name") == name).select(*by, *(F.col(c).alias(f"{side}_{c}") for c in ("score", "tie", "mass")))
            rows = rows.join(F.broadcast(at), by, "left")
            score, level, mark = F.col(column), F.col(f"{side}_score"), F.col(f"{side}_tie")
            inside = (score > level) | ((score == level) & (F.col(tie) < mark))
            mass[side] = F.when(inside, F.col(area)).when((score == level) & (F.col(tie) == mark), F.col(f"{side}_mass")).otherwise(0.0)
        overlap = rows.groupBy(*by).agg(ratio(F.sum(F.least(mass["l"], mass["r"])), F.sum(F.greatest(mass["l"], mass["r"]))).alias(f"top_{name}_iou"))
        out = out.join(overlap, by, "left")
    return out


def level_ends(levels: DataFrame, by: list[str], order: list[Column], size: str) -> DataFrame:
    """Levels with ``before`` and ``total``: the sum of sizes ahead of each in its group's order, and the group's. Running sums by ranges; groups are few."""
    placed = ranged_sums(levels, [*map(F.col, by), *order], {"_end": F.col(size)})
    span = placed.groupBy(*by).agg(F.min(F.col("_end") - F.col(size)).alias("_start"), F.sum(size).alias("total"))
    return placed.join(F.broadcast(span), by).withColumn("before", F.col("_end") - F.col(size) - F.col("_start")).drop("_end", "_start")


def rank_correlation(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """spearman() for few large groups: ranks come from counted values, so no task holds a group's rows."""
    cells = cut(df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))

    def ranks(side: str) -> DataFrame:
        ends = level_ends(cells.groupBy(*by, side).agg(F.sum("n").alias("m")), by, [F.col(side)], "m")
        return ends.select(*by, side, (F.col("before") + F.col("m") / 2 - F.col("total") / 2).alias(f"r{side}"))  # about the mean rank

    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    sums = cells.join(ranks("a"), [*by, "a"]).join(ranks("b"), [*by, "b"]).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * x * x).alias("va"), F.sum(n * y * y).alias("vb"), F.sum(n * x * y).alias("c"))
    return sums.select(*by, F.when((F.col("n") > 1) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / (F.sqrt("va") * F.sqrt("vb"))).alias("rho"))


def area_cuts(df: DataFrame, by: list[str], score: str, area: str, shares: dict[int, float], tie: str) -> DataFrame:
    """Where top_area() ends in each group, for each named share: name, the score and tie of the row at the boundary and its mass; rows before it count in full.

    Areas are summed by score first; only the rows of the boundary's score are put in order. The tie must tell rows apart.
    """
    levels = level_ends(df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(area).alias("size")), by, [F.desc("score")], "size")
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("share")) for k, v in shares.items())))
    reach = F.col("share") * F.col("total")
    at = cut(levels.withColumn("s", names).select(*by, "score", "size", "before", "total", "s.*").filter((F.col("before") < reach) & (reach <= F.col("before") + F.col("size"))))
    rows = df.withColumnRenamed(score, "score").join(F.broadcast(at.select(*by, "score", "name", "share", F.col("before").alias("ahead"), F.col("total").alias("whole"))), [*by, "score"]).select(*by, "score", "name", "share", "ahead", "whole", F.col(tie).alias("tie"), F.col(area).alias("size"))
    left = F.col("share") * F.col("whole") - F.col("ahead") - F.col("before")
    placed = level_ends(rows, [*by, "name"], [F.col("tie")], "size")
    return placed.filter((left > 0) & (left <= F.col("size"))).select(*by, "name", "score", "tie", left.alias("mass"))


def admission_summary(df: DataFrame, by: list[str], target: str, admitted: str) -> DataFrame:
    """Rates of owners with any admitted region: false ones among negatives, sensitivity among positives."""
    hit, real = F.col(admitted), F.col(target) == 1
    return df.groupBy(*by).agg(
        F.count_if(~real).alias("negatives"), F.count_if(real).alias("positives"), ratio(F.count_if(hit & ~real), F.count_if(~real)).alias("false_admission_rate"), ratio(F.count_if(hit & real), F.count_if(real)).alias("sensitivity"),
    )


def overlap_metrics(df: DataFrame, by: list[str], mask: Column, truth: Column, valid: Column) -> DataFrame:
    """Dice, intersection over union, precision and recall of a mask among valid points."""
    tp, predicted, real = F.count_if(mask & truth & valid), F.count_if(mask & valid), F.count_if(truth & valid)
    c = df.groupBy(*by).agg(tp.alias("tp"), predicted.alias("predicted"), real.alias("real"))
    both = F.col("predicted") + F.col("real")
    return c.select(*by, ratio(2 * F.col("tp"), both).alias("dice"), ratio(F.col("tp"), both - F.col("tp")).alias("iou"), ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("real")).alias("recall"))


def branch_rows(df: DataFrame, branches: dict[str, Column]) -> DataFrame:
    """One row for each branch of a row: branch, score; the other columns stay."""
    pairs = F.array(*(F.struct(F.lit(k).alias("branch"), v.cast("double").alias("score")) for k, v in branches.items()))
    return df.withColumn("pair", F.explode(pairs)).select(*df.columns, "pair.branch", "pair.score")


def transported(target: DataFrame, matches: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """The source field on the target's points by one-to-one matches (source_id, target_id): value and valid; uncovered ones are 0 and not valid."""
    got = matches.join(source.select(F.col(key).alias("source_id"), F.col(value).alias("moved")), "source_id").select(F.col("target_id").alias(key), "moved")
    return target.join(got, key, "left").select(key, F.coalesce("moved", F.lit(0.0)).alias(value), F.col("moved").isNotNull().alias("valid"))


def epoch_gains(df: DataFrame, by: list[str], refined: str, raw: str) -> DataFrame:
    return df.withColumn("gain", F.col(refined) - F.col(raw)).select(*by, "gain")


def campaign_cells(runs: DataFrame, expected: DataFrame, cell: list[str], seed: str, value: str) -> DataFrame:
    """Expected cells (cell, seed) with their one value: status complete, missing, duplicate or, for runs of none, unexpected."""
    seen = runs.groupBy(*cell, seed).agg(F.count("*").alias("runs"), F.min(value).alias("value"))
    j = expected.withColumn("wanted", F.lit(True)).join(seen, [*cell, seed], "full")
    status = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("runs").isNull(), "missing").when(F.col("runs") > 1, "duplicate").otherwise("complete")
    return j.select(*cell, seed, F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), status.alias("status"), F.when(status == "complete", F.col("value")).alias("value"))


def longest_first(df: DataFrame, size: str, key: str, tasks: int) -> DataFrame:
    """Jobs by size, largest first (ties by key), with the wave that each falls into when ``tasks`` run at once.

    Jobs are dealt by ranges of that order and counted by range, so that no task sees all jobs.
    """
    spark = df.sparkSession
    tasks_now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.select(key, size).repartitionByRange(tasks_now, F.desc(size), key).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a part
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.desc(size), key))
    return ranged.join(before.select("part", "before"), "part").withColumn("place", rank.cast("long")).select(key, size, "place", F.floor((F.col("place") - 1) / tasks).cast("long").alias("wave"))
