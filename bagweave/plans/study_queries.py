"""Evaluation, study and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagweave.functions.scalar import metric_name, ratio
from bagweave.operators import bags as bag_ops
from bagweave.operators import evaluation as ops
from bagweave.plans.registry import query
from bagweave.plans.views import BAGS, POINTS, RUNS, bags, points, runs, table

r6 = lambda c: F.round(c, 6).alias(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {BAGS}, c AS (SELECT phenotype, CAST(count(*) FILTER (p >= .5 AND target = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= .5 AND target = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (p < .5 AND target = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (p < .5 AND target = 1) AS DOUBLE) AS fn FROM bags GROUP BY 1)
SELECT phenotype, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 6) AS mcc FROM c""")
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.decision_metrics(bags(spark, sf_dir).withColumn("said", F.col("p") >= 0.5), ["phenotype"], "said", "target"))


CURVE = """l AS (SELECT slice, p, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS tp FROM bags GROUP BY ALL), w AS (SELECT *, n - tp AS neg, coalesce(sum(n - tp) OVER (PARTITION BY slice ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
sum(n) OVER d AS cn, sum(tp) OVER d AS ctp FROM l WINDOW d AS (PARTITION BY slice ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT slice, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap, sum(tp * (lower + neg / 2)) / nullif(sum(tp) * sum(neg), 0) AS auroc FROM w GROUP BY slice), u AS (SELECT slice, ap, auroc, CASE WHEN ap IS NOT NULL AND auroc IS NOT NULL THEN least(1, greatest(0, .7::DOUBLE * ap + .3::DOUBLE * auroc)) END AS utility FROM m)"""


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    m = bag_ops.average_precision(b, ["slice"]).join(bag_ops.auroc(b, ["slice"]), "slice")
    return m.select("slice", "ap", "auroc", ops.validation_utility(F.col("ap"), F.col("auroc")).alias("utility"))


@query(f"WITH {BAGS}, {CURVE} SELECT slice, round(ap, 6) AS ap, round(auroc, 6) AS auroc, round(utility, 6) AS utility FROM u")
def validation_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(utilities(spark, sf_dir))


@query(f"""WITH {BAGS}, {CURVE}, c AS (SELECT slice % 2 AS run, slice AS epoch, ap, auroc, round(utility, 9) AS utility FROM u) SELECT run, arg_max(epoch, (utility, -epoch)) AS epoch, round(arg_max(ap, (utility, -epoch)), 6) AS ap, round(arg_max(auroc, (utility, -epoch)), 6) AS auroc, round(max(utility), 6) AS best, round(arg_max(utility, epoch), 6) AS last, CAST(count(*) AS BIGINT) AS epochs FROM c WHERE utility IS NOT NULL GROUP BY run""")
def checkpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = utilities(spark, sf_dir).select((F.col("slice") % 2).alias("run"), F.col("slice").alias("epoch"), "ap", "auroc", F.round("utility", 9).alias("utility"))
    return rounded(ops.checkpoint_records(curve, ["run"], "epoch", "utility", ["ap", "auroc"]))


UNNESTED = "v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT dim, avg(x) AS mean, greatest(stddev_pop(x), 1e-6) AS scale FROM v WHERE vec_id % 3 <> 0 GROUP BY dim)"


@query(f"WITH {UNNESTED} SELECT CAST(dim AS INTEGER) AS dim, round(any_value(mean), 6) AS mean, round(any_value(scale), 6) AS scale, round(avg((x - mean) / scale), 6) AS held_out_mean, round(stddev_pop((x - mean) / scale), 6) AS held_out_scale FROM v JOIN s USING (dim) WHERE vec_id % 3 = 0 GROUP BY dim")
def embedding_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scaler = ops.fit_scaler(e.filter("vec_id % 3 <> 0"), "embedding")
    z = ops.standardized(e.filter("vec_id % 3 = 0"), "vec_id", "embedding", scaler).groupBy("dim").agg(F.avg("z").alias("held_out_mean"), F.stddev_pop("z").alias("held_out_scale"))
    return rounded(scaler.join(z, "dim"))


@query(f"""WITH {POINTS}, x AS (SELECT owner, 8 * p - 4 AS a, 7.5::DOUBLE * q - 3.5::DOUBLE AS b FROM points), m AS (SELECT avg((b - a) * (b - a)) AS mse, var_pop(a) AS variance, corr(a, b) AS pearson, CAST(count(*) AS BIGINT) AS points FROM x), g AS (SELECT owner, max(a) AS a, max(b) AS b FROM x GROUP BY owner),
w AS (SELECT avg(abs(a - b)) AS bag_mae, corr(a, b) AS bag_pearson, avg(abs(1 / (1 + exp(-a)) - 1 / (1 + exp(-b)))) AS bag_probability_mae, CAST(count(*) AS BIGINT) AS bags FROM g)
SELECT round(mse, 6) AS mse, round(pearson, 6) AS pearson, round(CASE WHEN variance > 1e-8 THEN 1 - mse / variance END, 6) AS r2, points, round(bag_mae, 6) AS bag_mae, round(bag_pearson, 6) AS bag_pearson, round(bag_probability_mae, 6) AS bag_probability_mae, bags, round(mse / greatest(variance, 1e-8) + bag_probability_mae, 6) AS selection_error FROM m, w""")
def code_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).select("owner", (8 * F.col("p") - 4).alias("a"), (7.5 * F.col("q") - 3.5).alias("b"))
    return rounded(ops.code_fidelity(x, "owner", "a", "b"))


@query("WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS unit, unnest(embedding) AS x FROM embeddings) SELECT CAST(unit AS INTEGER) AS unit, round(avg(CASE WHEN x > .2::FLOAT THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate, count(*) FILTER (x > .2::FLOAT) = 0 AS dead FROM v GROUP BY unit")
def activation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("unit", "x")).withColumn("code", F.greatest(F.col("x") - F.lit(0.2).cast("float"), F.lit(0).cast("float")))
    return rounded(ops.activation_rates(codes, "unit", "code"))


@query(f"WITH {RUNS} SELECT k AS lambda, CAST(count(*) AS BIGINT) AS n, round(avg(metric), 6) AS selection_error, round(avg(CASE WHEN status = 'error' THEN 0 ELSE 1.0::DOUBLE END), 6) AS active_fraction FROM runs GROUP BY k")
def calibration_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).groupBy(F.col("k").alias("lambda"))
    return rounded(r.agg(F.count("*").alias("n"), F.avg("metric").alias("selection_error"), F.avg((F.col("status") != "error").cast("double")).alias("active_fraction")))


@query(f"WITH {POINTS} SELECT owner, round(avg(p), 6) AS mean, round(sum(p * area) / sum(area), 6) AS area_mean, round(sum(p * area), 6) AS area_sum, max(p) AS max FROM points GROUP BY owner")
def global_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ops.global_reductions(points(spark, sf_dir), ["owner"], "p", "area")
    return g.select("owner", r6("mean"), r6("area_mean"), r6("area_sum"), "max")


MASS = "least(area, greatest(0, {s} * sum(area) OVER (PARTITION BY region) - coalesce(sum(area) OVER (PARTITION BY region ORDER BY {v} DESC, owner, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))"


@query(f"""WITH {POINTS}, x AS (SELECT region, owner * 10 + point // 1000000000 AS point, owner, area, valid, 8 * p - 4 AS a, 8 * q - 4 AS b, 1 / (1 + exp(4 - 8 * q)) AS bp, 1 / (1 + exp(4 - 8 * p)) AS ap FROM points),
e AS (SELECT region, round(sum(area) FILTER (valid) / sum(area), 6) AS coverage, CAST(count(*) FILTER (valid) AS BIGINT) AS supported, round(sum(area * abs(a - b)) FILTER (valid) / sum(area) FILTER (valid), 6) AS logit_mae, round(sqrt(sum(area * (a - b) * (a - b)) FILTER (valid) / sum(area) FILTER (valid)), 6) AS logit_rmse,
round(sum(area * abs(ap - bp)) FILTER (valid) / sum(area) FILTER (valid), 6) AS probability_mae, round(sqrt(sum(area * (ap - bp) * (ap - bp)) FILTER (valid) / sum(area) FILTER (valid)), 6) AS probability_rmse FROM x GROUP BY region),
k AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY a) + (count(*) OVER (PARTITION BY region, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY region ORDER BY b) + (count(*) OVER (PARTITION BY region, b) - 1) / 2.0::DOUBLE AS rb FROM x WHERE valid), s AS (SELECT region, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY region),
t AS (SELECT region, {MASS.format(s='.05::DOUBLE', v='a')} AS a5, {MASS.format(s='.05::DOUBLE', v='b')} AS b5, {MASS.format(s='.1::DOUBLE', v='a')} AS a10, {MASS.format(s='.1::DOUBLE', v='b')} AS b10 FROM x WHERE valid),
o AS (SELECT region, round(sum(least(a5, b5)) / nullif(sum(greatest(a5, b5)), 0), 6) AS top_5_iou, round(sum(least(a10, b10)) / nullif(sum(greatest(a10, b10)), 0), 6) AS top_10_iou FROM t GROUP BY region) SELECT * FROM e LEFT JOIN s USING (region) LEFT JOIN o USING (region)""")
def map_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).select("region", (F.col("owner") * 10 + F.floor(F.col("point") / 1000000000)).alias("point"), "area", "valid", (8 * F.col("p") - 4).alias("a"), (8 * F.col("q") - 4).alias("b"), (1 / (1 + F.exp(4 - 8 * F.col("q")))).alias("second_p"))
    return rounded(ops.map_comparison(x, ["region"], "a", "b", "area", "valid"))


@query(f"""WITH {POINTS}, {BAGS}, x AS (SELECT points.*, p >= .8::DOUBLE AS mask FROM points), o AS (SELECT owner, count(*) FILTER (mask AND target = 1 AND valid) AS tp, count(*) FILTER (mask AND valid) AS said, count(*) FILTER (target = 1 AND valid) AS truth, bool_or(mask) AS admitted, sum(CASE WHEN mask THEN area ELSE 0 END) AS area FROM x GROUP BY owner)
SELECT o.owner, admitted, round(o.area, 6) AS area, round(2 * tp / nullif(CAST(said + truth AS DOUBLE), 0), 6) AS dice, round(tp / nullif(CAST(said + truth - tp AS DOUBLE), 0), 6) AS iou, round(tp / nullif(CAST(said AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(truth AS DOUBLE), 0), 6) AS recall FROM o""")
def region_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).withColumn("mask", F.col("p") >= 0.8)
    any_ = x.groupBy("owner").agg(F.bool_or("mask").alias("admitted"), F.round(F.sum(F.when(F.col("mask"), F.col("area")).otherwise(0.0)), 6).alias("area"))
    return any_.join(rounded(ops.overlap_metrics(x, ["owner"], F.col("mask"), F.col("target") == 1, F.col("valid"))), "owner")


@query(f"""WITH {POINTS}, {BAGS}, a AS (SELECT owner, level, bool_or(p >= level) AS admitted FROM points, (VALUES (.5::DOUBLE), (.8::DOUBLE), (.95::DOUBLE)) l(level) GROUP BY ALL) SELECT level, CAST(count(*) FILTER (target = 0) AS BIGINT) AS negatives, CAST(count(*) FILTER (target = 1) AS BIGINT) AS positives,
round(count(*) FILTER (admitted AND target = 0) / nullif(CAST(count(*) FILTER (target = 0) AS DOUBLE), 0), 6) AS false_admission_rate, round(count(*) FILTER (admitted AND target = 1) / nullif(CAST(count(*) FILTER (target = 1) AS DOUBLE), 0), 6) AS sensitivity FROM a JOIN bags USING (owner) GROUP BY level""")
def admission_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = points(spark, sf_dir).groupBy("owner").agg(F.max("p").alias("peak")).join(bags(spark, sf_dir).select("owner", "target"), "owner")
    rows = peak.withColumn("level", F.explode(F.array(*(F.lit(x) for x in (0.5, 0.8, 0.95))))).withColumn("admitted", F.col("peak") >= F.col("level"))
    return rounded(ops.admission_summary(rows, ["level"], "target", "admitted"))


@query(f"""WITH {BAGS}, x AS (SELECT target, unnest([{{'branch': 'pooled', 'p': p}}, {{'branch': 'direct', 'p': u}}, {{'branch': 'mixed', 'p': (p + u) / 2}}]) AS b FROM bags), y AS (SELECT b.branch AS branch, target, round(b.p, 9) AS p FROM x), l AS (SELECT branch, p, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS tp FROM y GROUP BY ALL),
w AS (SELECT *, sum(n) OVER d AS cn, sum(tp) OVER d AS ctp FROM l WINDOW d AS (PARTITION BY branch ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), m AS (SELECT branch, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM w GROUP BY branch)
SELECT branch, round(ap, 6) AS ap, round(ap - (SELECT ap FROM m WHERE branch = 'direct'), 6) AS gain FROM m""")
def branch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    rows = ops.branch_rows(b.select("target", "p", "u"), {"pooled": F.col("p"), "direct": F.col("u"), "mixed": (F.col("p") + F.col("u")) / 2}).withColumn("score", F.round("score", 9))
    m = bag_ops.average_precision(rows, ["branch"], "score").select("branch", "ap")
    raw = m.filter("branch = 'direct'").select(F.col("ap").alias("raw"))
    return rounded(m.crossJoin(raw).select("branch", "ap", (F.col("ap") - F.col("raw")).alias("gain")))


@query(f"""WITH {RUNS}, e AS (SELECT t AS trial, s AS seed FROM range(32) a(t), range(7) b(s)), r AS (SELECT trial, seed, CAST(count(*) AS BIGINT) AS runs, min(metric) AS v FROM runs WHERE status = 'purchase' OR status = 'error' GROUP BY ALL)
SELECT trial, seed, coalesce(runs, 0) AS runs, CASE WHEN e.trial IS NULL THEN 'unexpected' WHEN r.runs IS NULL THEN 'missing' WHEN r.runs > 1 THEN 'duplicate' ELSE 'complete' END AS status, CASE WHEN e.trial IS NOT NULL AND r.runs = 1 THEN round(v, 6) END AS value FROM e FULL JOIN r USING (trial, seed)""")
def campaign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.range(32).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("seed"))
    done = runs(spark, sf_dir).filter("status = 'purchase' or status = 'error'")
    return rounded(ops.campaign_cells(done, expected, ["trial"], "seed", "metric"))


@query("SELECT o_orderkey AS job, o_totalprice AS size, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 64 AS BIGINT) AS wave FROM orders")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.longest_first(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("size")), "size", "job", 64)


@query("""SELECT trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS metric, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(metric_name(F.concat_ws(" / ", "p_type", "p_brand")).alias("metric"))
    return rounded(p.agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")))


@query("""WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, avg(n_chars) FILTER (quality = 1) AS a, avg(n_chars) FILTER (quality = 0) AS b, var_samp(n_chars) FILTER (quality = 1) AS va, var_samp(n_chars) FILTER (quality = 0) AS vb, count(*) FILTER (quality = 1) AS na, count(*) FILTER (quality = 0) AS nb FROM d GROUP BY lang),
x AS (SELECT lang, na, nb, CASE WHEN na >= 2 AND nb >= 2 AND va + vb > 0 THEN (a - b) / sqrt((va + vb) / 2) END AS smd FROM s) SELECT lang, CAST(na AS BIGINT) AS positive, CAST(nb AS BIGINT) AS negative, round(smd, 6) AS smd, abs(smd) >= .5 AS flagged FROM x""")
def shortcut_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    one = lambda f, q: f(F.when(F.col("quality") == q, F.col("n_chars").cast("double")))
    s = d.groupBy("lang").agg(*(one(f, q).alias(f"{n}{q}") for q in (0, 1) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))))
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    smd = F.when(enough, ratio(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)))
    return s.select("lang", F.col("n1").alias("positive"), F.col("n0").alias("negative"), F.round(smd, 6).alias("smd"), (F.abs(smd) >= 0.5).alias("flagged"))


@query("""WITH d AS (SELECT quality, lang, source FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT quality, 'lang' AS field, lang AS token FROM d UNION ALL SELECT quality, 'source', source FROM d)
SELECT quality, field, CAST(count(DISTINCT token) AS BIGINT) AS tokens, CAST(count(*) FILTER (token IS NULL) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS n, max(token) AS last_token FROM t GROUP BY quality, field""")
def diversity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t = d.select("quality", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("token")) for c in ("lang", "source")))).alias("t")).select("quality", "t.*")
    return t.groupBy("quality", "field").agg(F.countDistinct("token").alias("tokens"), F.count_if(F.col("token").isNull()).alias("missing"), F.count("*").alias("n"), F.max("token").alias("last_token"))


@query(f"""WITH {POINTS}, m AS (SELECT owner, 'point' AS mode, 1.0::DOUBLE AS w, p FROM points UNION ALL SELECT owner, 'area', area, p FROM points), x AS (SELECT owner, mode, p, w / sum(w) OVER (PARTITION BY owner, mode) AS m, max(p) OVER (PARTITION BY owner, mode) AS mx FROM m)
SELECT owner, mode, max(p) AS max, round(sum(m * p) + 1e-9, 6) AS mean, round(max(p) + ln(sum(m * exp(5 * (p - mx)))) / 5, 6) AS log_sum_exp, round(pow(sum(m * pow(p, 4)), .25), 6) AS gem, round((max(p) + sum(m * p)) / 2 + 1e-9, 6) AS max_mean FROM x GROUP BY owner, mode""")
def pooling_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooling families by both area modes: every point alike, or by its area. 1e-9 keeps exact halves of the last digit on one side."""
    p = points(spark, sf_dir)
    modes = p.withColumn("mode", F.lit("point")).withColumn("area", F.lit(1.0)).unionByName(p.withColumn("mode", F.lit("area")))
    out = bag_ops.pooled(modes, ["owner", "mode"])
    return out.select("owner", "mode", "max", F.round(F.col("area_mean") + 1e-9, 6).alias("mean"), F.round("lse", 6).alias("log_sum_exp"), r6("gem"), F.round(F.col("max_mean") + 1e-9, 6).alias("max_mean"))


@query(f"""WITH {RUNS}, s AS (SELECT trial, arg_max(k, (metric, attempt)) / 1000.0::DOUBLE AS selected FROM runs WHERE k IS NOT NULL GROUP BY trial), g AS (SELECT trial, selected, place, CASE WHEN selected = 0 THEN CASE place WHEN 1 THEN 0.0 WHEN 2 THEN 1e-6 ELSE 1e-5 END::DOUBLE ELSE selected * CASE place WHEN 1 THEN 1 / sqrt(10) WHEN 2 THEN 1 ELSE sqrt(10) END END AS weight FROM s, (VALUES (1), (2), (3)) t(place))
SELECT trial, CAST(place AS INTEGER) AS place, round(weight, 9) AS "lambda", sha256(trial || ':' || place || ':' || CAST(selected * 1000 AS INTEGER)) AS parameters FROM g""")
def lambda_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finer grid about the weight that each trial's best run took, and a digest of what each cell is made of."""
    best = runs(spark, sf_dir).filter("k is not null").groupBy("trial").agg((F.max_by("k", F.struct("metric", "attempt")) / F.lit(1000.0)).alias("selected"))
    cells = best.select("trial", "selected", F.posexplode(local_lambdas(F.col("selected"))).alias("k", "lambda")).withColumn("place", F.col("k") + 1)
    return cells.select("trial", "place", F.round("lambda", 9).alias("lambda"), F.sha2(F.concat_ws(":", "trial", "place", F.round(F.col("selected") * 1000).cast("int")), 256).alias("parameters"))


def local_lambdas(selected: Column) -> Column:
    """Three values about the selected one, half a decade apart; from 0 upward where that is selected."""
    return F.when(selected == 0, F.array(F.lit(0.0), F.lit(1e-6), F.lit(1e-5))).otherwise(F.array(*(selected * 10 ** (e / 2) for e in (-1, 0, 1))))


@query(f"""WITH {RUNS}, k AS (SELECT run, trial, seed, metric, status FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY attempt DESC) AS r FROM runs) WHERE r = 1), t AS (SELECT trial, avg(metric) AS mean FROM k WHERE status <> 'error' GROUP BY trial), b AS (SELECT trial, mean, row_number() OVER (ORDER BY mean DESC, trial) AS place FROM t)
SELECT b.trial, CAST(place AS BIGINT) AS place, round(mean, 6) AS mean, CAST(count(*) AS BIGINT) AS runs, round(max(metric), 6) AS best, arg_max(run, (metric, -run)) AS chosen FROM b JOIN k USING (trial) WHERE place <= 5 AND status <> 'error' GROUP BY ALL""")
def study_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run's latest attempt that didn't fail: the five best trials by mean, and the best run of each."""
    last = runs(spark, sf_dir).groupBy("run").agg(F.max_by(F.struct("trial", "metric", "status"), "attempt").alias("k")).select("run", "k.*").filter("status <> 'error'")
    means = last.groupBy("trial").agg(F.avg("metric").alias("mean")).orderBy(F.desc("mean"), "trial").limit(5)
    best = means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "trial")).cast("long"))  # five rows
    out = last.join(F.broadcast(best), "trial").groupBy("trial", "place", "mean").agg(F.count("*").alias("runs"), F.max("metric").alias("best"), F.max_by("run", F.struct(F.col("metric"), -F.col("run"))).alias("chosen"))
    return rounded(out)
