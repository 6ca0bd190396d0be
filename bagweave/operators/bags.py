"""Bags of scored points: ranking metrics, pooling, masses and losses per bag. Undefined results are NULL.

Every operator groups by the bag's key; windows are partitioned by it, so no operator gathers more than a bag's points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.ranged import dealt
from bagweave.functions.scalar import binary_entropy, logit, ratio, softplus


def average_precision(df: DataFrame, by: list[str], score: str = "p", target: str = "target") -> DataFrame:
    """Step-wise average precision over distinct scores, NULL without positives: by, n, positives, ap."""
    levels = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(target).alias("tp"))
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = levels.withColumn("cn", F.sum("n").over(down)).withColumn("ctp", F.sum("tp").over(down))
    return cumulative.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("tp").alias("positives"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s")).select(*by, "n", "positives", ratio(F.col("s"), F.col("positives")).alias("ap"))


def auroc(df: DataFrame, by: list[str], score: str = "p", target: str = "target") -> DataFrame:
    """Area under the ROC curve with half credit for ties, NULL without both classes: by, auroc."""
    levels = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(target).alias("tp"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = levels.withColumn("neg", F.col("n") - F.col("tp")).withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return wins.groupBy(*by).agg(F.sum(F.col("tp") * (F.col("lower") + F.col("neg") / 2)).alias("w"), F.sum("tp").alias("p"), F.sum("neg").alias("m")).select(*by, ratio(F.col("w"), F.col("p") * F.col("m")).alias("auroc"))


def top_fraction(df: DataFrame, by: list[str], fraction: float, score: str = "p", target: str = "target", tie: str = "point") -> DataFrame:
    """Recall and enrichment of the top max(1, ceil(fraction * n)) points; ties go to the lower point: by, k, recall, enrichment."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("r", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.count("*").over(w))))
    a = ranked.groupBy(*by).agg(F.max("k").alias("k"), F.sum(F.when(F.col("r") <= F.col("k"), F.col(target)).otherwise(0)).alias("hits"), F.sum(target).alias("positives"), F.count("*").alias("n"))
    return a.select(*by, "k", ratio(F.col("hits"), F.col("positives")).alias("recall"), ratio(F.col("hits") / F.col("k"), F.col("positives") / F.col("n")).alias("enrichment"))


def confusion(df: DataFrame, by: list[str], score: str = "p", target: str = "target", threshold: float = 0.5) -> DataFrame:
    hit, real = F.col(score) >= threshold, F.col(target) == 1
    return df.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Ten metrics of confusion counts, each NULL where undefined; kappa is undefined where the expected agreement is 1."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    agree, expect = ratio(tp + tn, n), ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return counts.withColumns({
        "accuracy": agree, "precision": precision, "recall": recall, "specificity": specificity, "npv": ratio(tn, tn + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + specificity) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)), "kappa": F.when(F.abs(expect - 1) > 1e-9, ratio(agree - expect, 1 - expect)), "youden": recall + specificity - 1,
    })


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, NULL for fewer than two points or a constant side."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = dealt(df.select(*by, a, b), by).withColumn("ra", rank(a)).withColumn("rb", rank(b))
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"), F.covar_pop("ra", "rb").alias("c"))
    return sums.select(*by, F.when((F.col("n") > 1) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("rho"))


def selective(df: DataFrame, coverage: float, uncertainty: str, quality: str, by: list[str], tie: str = "owner") -> DataFrame:
    """Mean quality of the ceil(coverage * n) least uncertain rows."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("r", F.row_number().over(w.orderBy(uncertainty, tie))).withColumn("k", F.ceil(F.lit(coverage) * F.count("*").over(w)))
    return ranked.filter("r <= k").groupBy(*by).agg(F.avg(quality).alias("quality"), F.count("*").alias("n"))


def top_area(df: DataFrame, by: list[str], score: str, area: str, share: float, tie: str = "point") -> DataFrame:
    """Adds mass: each point's area inside the top share of the bag's area, the boundary point in part."""
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum(area).over(w.orderBy(F.col(score).desc(), tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("mass", F.least(F.col(area), F.greatest(F.lit(0.0), share * F.sum(area).over(w) - before)))


def softmax_weights(df: DataFrame, by: list[str], score: Column, mask: Column) -> DataFrame:
    """Adds weight: softmax over the unmasked rows of a group; masked rows get 0."""
    w = Window.partitionBy(*by)
    kept = F.when(mask, score)
    e = F.when(mask, F.exp(score - F.max(kept).over(w))).otherwise(0.0)
    return df.withColumn("weight", ratio(e, F.sum(e).over(w)))


def pooled(df: DataFrame, by: list[str], p: str = "p", area: str = "area", beta: float = 5.0, alpha: float = 3.0, power: float = 4.0, mix: float = 0.5, share: float = 0.1, attention: str = "q", tie: str = "point") -> DataFrame:
    """Pooled scores of a bag: max, means, attention, top-k by points and by area, log-sum-exp, linear softmax, autopool, generalized mean, max-mean."""
    w = Window.partitionBy(*by)
    df = top_area(dealt(df, by), by, p, area, share, tie)
    m = F.col(area) / F.sum(area).over(w)
    rows = df.withColumns({
        "m": m, "rank": F.row_number().over(w.orderBy(F.col(p).desc(), tie)), "n": F.count("*").over(w), "most": F.max(p).over(w),
        "att": F.exp(F.col(attention) - F.max(attention).over(w)),
    })
    rows = rows.withColumn("auto", F.exp(alpha * F.col(p) + F.log(F.col("m")) - F.max(alpha * F.col(p) + F.log(F.col("m"))).over(w)))
    x, k = F.col(p), F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))
    mean = F.sum(F.col("m") * x)
    return rows.groupBy(*by).agg(
        F.max(x).alias("max"), F.avg(x).alias("mean"), mean.alias("area_mean"), ratio(F.sum(F.col("att") * x), F.sum("att")).alias("attention"), F.avg(F.when(F.col("rank") <= k, x)).alias("top_k"),
        ratio(F.sum(F.col("mass") * x), F.sum("mass")).alias("top_area"), (F.max(x) + F.log(F.sum(F.col("m") * F.exp(beta * (x - F.col("most"))))) / beta).alias("lse"), ratio(F.sum(F.col("m") * x * x), mean).alias("linear_softmax"),
        ratio(F.sum(F.col("auto") * x), F.sum("auto")).alias("autopool"), F.pow(F.sum(F.col("m") * F.pow(x, F.lit(power))), F.lit(1 / power)).alias("gem"), (mix * F.max(x) + (1 - mix) * mean).alias("max_mean"),
    )


def masses(df: DataFrame, by: list[str], p: str = "p", area: str = "area") -> DataFrame:
    """Per bag: expected mass, peak, area-weighted entropy of the map in bits, entropy of the masses over ln n."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("m", F.col(area) / F.sum(area).over(w)).withColumn("share", ratio(F.col(p), F.sum(p).over(w)))
    e = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0))
    return rows.groupBy(*by).agg(F.sum(F.col("m") * F.col(p)).alias("mass"), F.max(p).alias("peak"), F.sum(F.col("m") * binary_entropy(F.col(p))).alias("entropy"), F.when((F.count("*") > 1) & (F.sum(p) > 0), e / F.log(F.count("*").cast("double"))).alias("spread"))


def weak_losses(df: DataFrame, by: list[str], bag_target: str, p: str = "p", area: str = "area", low: float = 0.05, high: float = 0.6) -> DataFrame:
    """Per bag: area-weighted cross entropy against 0 (negatives), existence of one positive (positives), cardinality bounds."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("m", F.col(area) / F.sum(area).over(w)).withColumn("x", logit(F.col(p)))
    a = rows.groupBy(*by).agg(F.max(bag_target).alias("t"), F.sum(F.col("m") * softplus(F.col("x"))).alias("bce"), F.max("x").alias("mx"), F.sum(F.col("m") * F.col(p)).alias("mass"))
    pos, neg = F.col("t") == 1, F.col("t") == 0
    return a.select(*by, F.when(neg, F.col("bce")).alias("negative"), F.when(pos, softplus(-F.col("mx"))).alias("existence"), F.when(pos, F.greatest(F.lit(0.0), low - F.col("mass")) + F.greatest(F.lit(0.0), F.col("mass") - high)).alias("cardinality"))
