"""Bag and point queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.scalar import logit, sigmoid, softplus
from bagweave.operators import bags as ops
from bagweave.plans.registry import query
from bagweave.plans.views import BAGS, POINTS, bags, points

r6 = lambda c: F.round(c, 6).alias(c)
LEVELS = """levels AS (SELECT owner, p, count(*) AS n, sum(target) AS tp FROM points GROUP BY owner, p)"""
AP = f"""{LEVELS}, cumulative AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp FROM levels WINDOW w AS (PARTITION BY owner ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT owner, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS positives, CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / CAST(cn AS DOUBLE)) / sum(tp) END AS ap FROM cumulative GROUP BY owner)"""


def top_cte(name: str, share: float) -> str:
    return f"""{name} AS (SELECT owner, max(k) AS k, CAST(sum(CASE WHEN r <= k THEN target ELSE 0 END) AS DOUBLE) / nullif(sum(target), 0) AS recall,
 (CAST(sum(CASE WHEN r <= k THEN target ELSE 0 END) AS DOUBLE) / max(k)) / nullif(CAST(sum(target) AS DOUBLE) / count(*), 0) AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY p DESC, point) AS r,
 greatest(1, CAST(ceil({share}::DOUBLE * count(*) OVER (PARTITION BY owner)) AS BIGINT)) AS k FROM points) GROUP BY owner)"""


@query(f"""WITH {POINTS}, {AP}, {top_cte("t5", 0.05)}, {top_cte("t10", 0.1)}, {top_cte("t25", 0.25)}
SELECT ap.owner, n, positives, round(positives / CAST(n AS DOUBLE), 6) AS prevalence, round(ap, 6) AS ap, round(t5.recall, 6) AS recall_5, round(t10.recall, 6) AS recall_10, round(t25.recall, 6) AS recall_25, round(t10.enrichment, 6) AS enrichment_10
FROM ap JOIN t5 USING (owner) JOIN t10 USING (owner) JOIN t25 USING (owner)""")
def bag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = ops.average_precision(p, ["owner"])
    for name, share in (("5", 0.05), ("10", 0.1), ("25", 0.25)):
        t = ops.top_fraction(p, ["owner"], share)
        out = out.join(t.select("owner", F.round("recall", 6).alias(f"recall_{name}"), F.round("enrichment", 6).alias(f"enrichment_{name}")), "owner")
    return out.select("owner", "n", "positives", F.round(F.col("positives") / F.col("n"), 6).alias("prevalence"), r6("ap"), "recall_5", "recall_10", "recall_25", "enrichment_10")


@query(f"""WITH {POINTS}, {AP} SELECT CAST(count(*) AS BIGINT) AS bags, CAST(count(ap) AS BIGINT) AS evaluable, round(avg(ap), 6) AS macro_ap, round(stddev_samp(ap), 6) AS sd, round(quantile_cont(ap, 0.25), 6) AS q25, round(quantile_cont(ap, 0.5), 6) AS q50,
round(quantile_cont(ap, 0.75), 6) AS q75 FROM ap""")
def surface_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("ap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    ap = ops.average_precision(points(spark, sf_dir), ["owner"])
    return ap.agg(F.count("*").alias("bags"), F.count("ap").alias("evaluable"), F.round(F.avg("ap"), 6).alias("macro_ap"), F.round(F.stddev_samp("ap"), 6).alias("sd"), *(F.round(q[i], 6).alias(f"q{n}") for i, n in enumerate((25, 50, 75))))


@query(f"""WITH {BAGS}, l AS (SELECT phenotype, p, count(*) AS n, sum(target) AS tp FROM bags GROUP BY ALL), w AS (SELECT *, n - tp AS neg, coalesce(sum(n - tp) OVER (PARTITION BY phenotype ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
sum(n) OVER d AS cn, sum(tp) OVER d AS ctp FROM l WINDOW d AS (PARTITION BY phenotype ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT phenotype, round(CAST(sum(tp * (lower + neg / 2.0::DOUBLE)) AS DOUBLE) / (sum(tp) * sum(neg)), 6) AS auroc, round(sum(tp * ctp / CAST(cn AS DOUBLE)) / sum(tp), 6) AS ap FROM w GROUP BY phenotype""")
def ranking_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    return ops.auroc(b, ["phenotype"]).join(ops.average_precision(b, ["phenotype"]), "phenotype").select("phenotype", r6("auroc"), r6("ap"))


@query(f"""WITH {BAGS}, c AS (SELECT slice, count(*) FILTER (p >= .5 AND target = 1) AS tp, count(*) FILTER (p >= .5 AND target = 0) AS fp, count(*) FILTER (p < .5 AND target = 0) AS tn, count(*) FILTER (p < .5 AND target = 1) AS fn FROM bags GROUP BY slice),
d AS (SELECT *, CAST(tp AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(tn AS DOUBLE) AS e, CAST(fn AS DOUBLE) AS f, CAST(tp + fp + tn + fn AS DOUBLE) AS n FROM c), g AS (SELECT *, ((a + b) * (a + f) + (e + f) * (e + b)) / (n * n) AS x FROM d)
SELECT slice, tp, fp, tn, fn, round((a + e) / n, 6) AS accuracy, round(a / nullif(a + b, 0), 6) AS precision, round(a / nullif(a + f, 0), 6) AS recall, round(e / nullif(e + b, 0), 6) AS specificity, round(e / nullif(e + f, 0), 6) AS npv,
round(2 * a / nullif(2 * a + b + f, 0), 6) AS f1, round((a / nullif(a + f, 0) + e / nullif(e + b, 0)) / 2, 6) AS balanced_accuracy, round((a * e - b * f) / nullif(sqrt(a + b) * sqrt(a + f) * sqrt(e + b) * sqrt(e + f), 0), 6) AS mcc,
CASE WHEN abs(x - 1) > 1e-9 THEN round(((a + e) / n - x) / (1 - x), 6) END AS kappa, round(a / nullif(a + f, 0) + e / nullif(e + b, 0) - 1, 6) AS youden FROM g""")
def binary_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.binary_metrics(ops.confusion(bags(spark, sf_dir), ["slice"]))
    return m.select("slice", "tp", "fp", "tn", "fn", *(r6(c) for c in m.columns[5:]))


RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"


@query(f"""WITH {POINTS}, r AS (SELECT owner, {RANKS.format(by="owner", c="p")} AS a, {RANKS.format(by="owner", c="q")} AS b FROM points), s AS (SELECT owner, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM r GROUP BY owner)
SELECT owner, CASE WHEN n > 1 AND va > 0 AND vb > 0 THEN round(c / sqrt(va * vb), 6) END AS rho FROM s""")
def spearman_per_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spearman(points(spark, sf_dir), ["owner"], "p", "q").select("owner", r6("rho"))


@query(f"""WITH {BAGS}, r AS (SELECT *, abs(p - target) AS err, row_number() OVER (PARTITION BY phenotype ORDER BY u, owner) AS r, count(*) OVER (PARTITION BY phenotype) AS n FROM bags)
SELECT phenotype, round(avg(CASE WHEN r <= ceil(.9::DOUBLE * n) THEN err END), 6) AS risk_90, round(avg(CASE WHEN r <= ceil(.8::DOUBLE * n) THEN err END), 6) AS risk_80, round(avg(CASE WHEN r <= ceil(.7::DOUBLE * n) THEN err END), 6) AS risk_70 FROM r GROUP BY phenotype""")
def selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir).withColumn("err", F.abs(F.col("p") - F.col("target")))
    parts = [ops.selective(b, c / 100, "u", "err", ["phenotype"]).select("phenotype", F.round("quality", 6).alias(f"risk_{c}")) for c in (90, 80, 70)]
    return parts[0].join(parts[1], "phenotype").join(parts[2], "phenotype")


@query(f"""WITH {POINTS}, a AS (SELECT owner, point, area, least(area, greatest(0, .1::DOUBLE * sum(area) OVER (PARTITION BY owner) - coalesce(sum(area) OVER (PARTITION BY owner ORDER BY p DESC, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS m,
least(area, greatest(0, .1::DOUBLE * sum(area) OVER (PARTITION BY owner) - coalesce(sum(area) OVER (PARTITION BY owner ORDER BY q DESC, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS k FROM points)
SELECT owner, round(sum(m), 6) AS top_mass, round(sum(least(m, k)) / sum(greatest(m, k)), 6) AS iou FROM a GROUP BY owner""")
def top_area_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ops.top_area(points(spark, sf_dir), ["owner"], "p", "area", 0.1).withColumnRenamed("mass", "m")
    a = ops.top_area(a, ["owner"], "q", "area", 0.1)
    return a.groupBy("owner").agg(F.round(F.sum("m"), 6).alias("top_mass"), F.round(F.sum(F.least("m", "mass")) / F.sum(F.greatest("m", "mass")), 6).alias("iou"))


@query(f"""WITH {POINTS}, a AS (SELECT *, CASE WHEN valid THEN exp(3 * q - max(CASE WHEN valid THEN 3 * q END) OVER (PARTITION BY owner)) ELSE 0 END AS e FROM points), b AS (SELECT *, e / nullif(sum(e) OVER (PARTITION BY owner), 0) AS w FROM a)
SELECT owner, round(sum(w * p), 6) AS transferred, round(sum(w), 6) AS total, round(sum(w * p * p) - pow(sum(w * p), 2), 6) AS variance, max(CASE WHEN w > 0 THEN p END) AS most, CAST(count(*) FILTER (w > 0) AS BIGINT) AS support FROM b GROUP BY owner""")
def softmax_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ops.softmax_weights(points(spark, sf_dir), ["owner"], 3 * F.col("q"), F.col("valid"))
    mean = F.sum(F.col("weight") * F.col("p"))
    return w.groupBy("owner").agg(
        F.round(mean, 6).alias("transferred"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.sum(F.col("weight") * F.col("p") * F.col("p")) - mean * mean, 6).alias("variance"),
        F.max(F.when(F.col("weight") > 0, F.col("p"))).alias("most"), F.count_if(F.col("weight") > 0).alias("support"),
    )


@query(f"""WITH {POINTS}, a AS (SELECT *, area / sum(area) OVER (PARTITION BY owner) AS m, row_number() OVER (PARTITION BY owner ORDER BY p DESC, point) AS r, count(*) OVER (PARTITION BY owner) AS n, max(p) OVER (PARTITION BY owner) AS mx, exp(q - max(q) OVER (PARTITION BY owner)) AS att,
least(area, greatest(0, .1::DOUBLE * sum(area) OVER (PARTITION BY owner) - coalesce(sum(area) OVER (PARTITION BY owner ORDER BY p DESC, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS mass FROM points),
b AS (SELECT *, exp(3 * p + ln(m) - max(3 * p + ln(m)) OVER (PARTITION BY owner)) AS auto FROM a)
SELECT owner, max(p) AS max, round(avg(p) + 1e-9, 6) AS mean, round(sum(m * p) + 1e-9, 6) AS area_mean, round(sum(att * p) / sum(att) + 1e-9, 6) AS attention, round(avg(CASE WHEN r <= greatest(1, ceil(.1::DOUBLE * n)) THEN p END) + 1e-9, 6) AS top_k, round(sum(mass * p) / sum(mass) + 1e-9, 6) AS top_area,
round(max(p) + ln(sum(m * exp(5 * (p - mx)))) / 5 + 1e-9, 6) AS lse, round(sum(m * p * p) / nullif(sum(m * p), 0) + 1e-9, 6) AS linear_softmax, round(sum(auto * p) / sum(auto) + 1e-9, 6) AS autopool, round(pow(sum(m * pow(p, 4)), .25) + 1e-9, 6) AS gem, round(.5 * max(p) + .5 * sum(m * p) + 1e-9, 6) AS max_mean FROM b GROUP BY owner""")
def bag_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1e-9 keeps exact halves of the last digit on one side, whatever the order of the sums."""
    out = ops.pooled(points(spark, sf_dir), ["owner"])
    return out.select("owner", "max", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns[2:]))


@query(f"""WITH {POINTS}, a AS (SELECT *, area / sum(area) OVER (PARTITION BY owner) AS m, p / nullif(sum(p) OVER (PARTITION BY owner), 0) AS s, least(greatest(p, 1e-7), 1 - 1e-7) AS c FROM points)
SELECT owner, round(sum(m * p), 6) AS mass, max(p) AS peak, round(sum(m * -(c * log2(c) + (1 - c) * log2(1 - c))), 6) AS entropy, CASE WHEN count(*) > 1 AND sum(p) > 0 THEN round(-sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / ln(count(*)), 6) END AS spread FROM a GROUP BY owner""")
def bag_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.masses(points(spark, sf_dir), ["owner"]).select("owner", r6("mass"), "peak", r6("entropy"), r6("spread"))


@query(f"""WITH {POINTS}, {BAGS}, a AS (SELECT points.owner, bags.target AS t, points.area / sum(points.area) OVER (PARTITION BY points.owner) AS m, points.p AS p, ln(least(greatest(points.p, 1e-7), 1 - 1e-7) / (1 - least(greatest(points.p, 1e-7), 1 - 1e-7))) AS x FROM points JOIN bags ON points.owner = bags.owner),
b AS (SELECT owner, max(t) AS t, sum(m * (greatest(x, 0) + ln(1 + exp(-abs(x))))) AS bce, max(x) AS mx, sum(m * p) AS mass FROM a GROUP BY owner)
SELECT owner, CASE WHEN t = 0 THEN round(bce, 5) END AS negative, CASE WHEN t = 1 THEN round(greatest(-mx, 0) + ln(1 + exp(-abs(mx))), 5) END AS existence, CASE WHEN t = 1 THEN round(greatest(0, .05 - mass) + greatest(0, mass - .6) + 1e-9, 5) END AS cardinality FROM b""")
def weak_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).join(bags(spark, sf_dir).select("owner", F.col("target").alias("bag_target")), "owner")
    return ops.weak_losses(rows, ["owner"], "bag_target").select("owner", *(F.round(c, 5).alias(c) for c in ("negative", "existence")), F.round(F.col("cardinality") + 1e-9, 5).alias("cardinality"))


@query(f"""WITH {BAGS}, x AS (SELECT *, ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7))) AS a, ln(least(greatest(u, 1e-7), 1 - 1e-7) / (1 - least(greatest(u, 1e-7), 1 - 1e-7))) AS b FROM bags)
SELECT slice, round(avg(.7 * (greatest(a, 0) - a * target + ln(1 + exp(-abs(a)))) + .3 * (greatest(b, 0) - b * target + ln(1 + exp(-abs(b))))), 5) AS loss FROM x GROUP BY slice""")
def two_head_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = lambda x: softplus(x) - x * F.col("target")
    return bags(spark, sf_dir).groupBy("slice").agg(F.round(F.avg(0.7 * loss(logit(F.col("p"))) + 0.3 * loss(logit(F.col("u")))), 5).alias("loss"))


@query(f"""WITH {POINTS}, o AS (SELECT owner, target, p, m FROM (SELECT *, area / sum(area) OVER (PARTITION BY owner) AS m FROM points)), a AS (SELECT owner, max(CASE WHEN target = 1 THEN p END) AS pos, max(CASE WHEN target = 0 THEN p END) AS neg FROM o GROUP BY owner)
SELECT owner, round(greatest(0, .2 - pos + neg), 6) AS hinge FROM a WHERE pos IS NOT NULL AND neg IS NOT NULL""")
def regional_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = points(spark, sf_dir).groupBy("owner").agg(F.max(F.when(F.col("target") == 1, F.col("p"))).alias("pos"), F.max(F.when(F.col("target") == 0, F.col("p"))).alias("neg"))
    return a.filter("pos is not null and neg is not null").select("owner", F.round(F.greatest(F.lit(0.0), 0.2 - F.col("pos") + F.col("neg")), 6).alias("hinge"))


@query(f"""WITH {POINTS}, a AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY p DESC, point) AS r, count(*) OVER (PARTITION BY owner) AS n, sum(area) OVER (PARTITION BY owner ORDER BY p DESC, point ROWS UNBOUNDED PRECEDING) AS c, sum(area) OVER (PARTITION BY owner) AS s FROM points),
b AS (SELECT *, r < n AND (r = 1 OR c - area < .2::DOUBLE * s) AS cut FROM a) SELECT owner, CAST(count(*) FILTER (cut) AS BIGINT) AS removed, round(max(p), 6) AS full, max(CASE WHEN NOT cut THEN p END) AS deleted, max(CASE WHEN cut THEN p END) AS inserted FROM b WHERE n > 1 GROUP BY owner""")
def deletion_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("owner")
    o = w.orderBy(F.col("p").desc(), "point")
    a = points(spark, sf_dir).withColumns({"r": F.row_number().over(o), "n": F.count("*").over(w), "c": F.sum("area").over(o.rowsBetween(Window.unboundedPreceding, 0)), "s": F.sum("area").over(w)})
    b = a.filter("n > 1").withColumn("cut", (F.col("r") < F.col("n")) & ((F.col("r") == 1) | (F.col("c") - F.col("area") < 0.2 * F.col("s"))))
    return b.groupBy("owner").agg(F.count_if("cut").alias("removed"), F.round(F.max("p"), 6).alias("full"), F.max(F.when(~F.col("cut"), F.col("p"))).alias("deleted"), F.max(F.when(F.col("cut"), F.col("p"))).alias("inserted"))


@query(f"""WITH {BAGS}, g AS (SELECT owner, slice, ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7))) AS a FROM bags)
SELECT slice, round(sum(1 / (1 + exp(-(a - 2.0 / 3 * ln(.1 / 1.1))))), 5) AS penalty, round(avg(least(1, greatest(0, 1 / (1 + exp(-a)) * 1.2 - .1))), 5) AS gate FROM g GROUP BY slice""")
def hard_concrete_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    a = logit(F.col("p"))
    return bags(spark, sf_dir).groupBy("slice").agg(F.round(F.sum(sigmoid(a - 2 / 3 * math.log(0.1 / 1.1))), 5).alias("penalty"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sigmoid(a) * 1.2 - 0.1))), 5).alias("gate"))
