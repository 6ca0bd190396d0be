"""Run, trial, threshold and curve queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.operators import policies as ops
from bagweave.plans.registry import query
from bagweave.plans.views import BAGS, RUNS, bags, runs, table


@query(f"WITH {RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY attempt DESC) AS r FROM runs) SELECT run, attempt, status, metric FROM l WHERE r = 1 AND status = 'purchase'")
def latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_eligible(runs(spark, sf_dir), ["run"], "attempt", "status", "purchase").select("run", "attempt", "status", "metric")


@query(f"WITH {RUNS} SELECT attempt FROM runs WHERE (seed = 3 AND status IN ('view', 'click')) OR (trial = 4)")
def parameter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("parameters", F.create_map(F.lit("seed"), F.col("seed").cast("string"), F.lit("status"), F.col("status"), F.lit("trial"), F.col("trial").cast("string")))
    return r.filter(ops.matches([{"seed": 3, "status": ["view", "click"]}, {"trial": 4}, {"absent": 1}])).select("attempt")


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pareto(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("""WITH f AS (SELECT DISTINCT p_size AS c, p_retailprice AS v FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))), x AS (SELECT min(c) AS c0, max(c) AS c1, min(v) AS v0, max(v) AS v1 FROM f)
SELECT c AS p_size, v AS p_retailprice FROM f, x ORDER BY round((v - v0) / nullif(v1 - v0, 0) - (c - c0) / nullif(CAST(c1 - c0 AS DOUBLE), 0), 9) DESC NULLS LAST, c LIMIT 1""")
def pareto_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pareto_knee(table(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query(f"WITH {RUNS} SELECT trial, round(quantile_cont(metric, .5), 6) AS median, round(avg(metric), 6) AS mean, CAST(count(*) AS BIGINT) AS seeds FROM runs GROUP BY trial ORDER BY quantile_cont(metric, .5) DESC, trial LIMIT 5")
def top_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_trials(runs(spark, sf_dir), "trial", "metric", 5).select("trial", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), "seeds")


@query(f"""WITH {RUNS}, s AS (SELECT trial, seed, round(avg(metric), 4) AS m FROM runs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY m, seed) AS r, count(*) OVER (PARTITION BY trial) AS n, avg(m) OVER (PARTITION BY trial) AS a FROM s)
SELECT trial, arg_max(seed, (m, -seed)) AS best, arg_min(seed, (m, seed)) AS worst, max(CASE WHEN r = (n + 1) // 2 THEN seed END) AS median, arg_min(seed, (round(abs(m - a), 9), seed)) AS representative FROM r GROUP BY trial""")
def seed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runs(spark, sf_dir).groupBy("trial", "seed").agg(F.round(F.avg("metric"), 4).alias("m"))
    return ops.seed_choices(s, "trial", "seed", "m")


@query(f"""WITH {BAGS}, t AS (SELECT owner, 'false_positive' AS reason, row_number() OVER (ORDER BY -p, owner) AS r, 0 AS c FROM bags WHERE target = 0 AND p >= .5 UNION ALL SELECT owner, 'false_negative', row_number() OVER (ORDER BY p, owner), 1 FROM bags WHERE target = 1 AND p < .5
UNION ALL SELECT owner, 'disagreement', row_number() OVER (ORDER BY -abs(p - u), owner), 2 FROM bags), k AS (SELECT owner, min((r, c)) AS turn, list_sort(list(DISTINCT reason)) AS reasons FROM t WHERE r <= 10 GROUP BY owner), o AS (SELECT *, row_number() OVER (ORDER BY turn) AS place FROM k) SELECT owner, CAST(place AS INTEGER) AS place, array_to_string(reasons, ',') AS reasons FROM o WHERE place <= 15""")
def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    kinds = {
        "false_positive": ((F.col("target") == 0) & (F.col("p") >= 0.5), -F.col("p")), "false_negative": ((F.col("target") == 1) & (F.col("p") < 0.5), F.col("p")), "disagreement": (F.lit(True), -F.abs(F.col("p") - F.col("u"))),
    }
    return ops.round_robin(b, "owner", kinds, 10, 15).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {BAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p DESC, owner) AS r FROM bags) SELECT owner, family, p FROM r WHERE r <= 2 ORDER BY p DESC, family, owner LIMIT 300")
def budgeted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.capped_budget(bags(spark, sf_dir), "family", "p", "owner", 2, 300).select("owner", "family", "p")


@query(f"WITH {BAGS} SELECT owner, CASE WHEN row_number() OVER (PARTITION BY family ORDER BY p DESC, owner) = 1 THEN 1 ELSE 2 END AS tier FROM bags")
def family_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.families_first(bags(spark, sf_dir), "family", "p", "owner").select("owner", "tier")


@query(f"WITH {BAGS}, r AS (SELECT u FROM bags WHERE target = 0 AND slice < 3) SELECT owner, round((1 + (SELECT count(*) FROM r WHERE r.u >= bags.p)) / CAST((SELECT count(*) FROM r) + 1 AS DOUBLE), 9) AS pvalue FROM bags WHERE slice >= 3")
def tail_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    return ops.tail_pvalues(b.filter("slice >= 3"), "p", b.filter("target = 0 and slice < 3"), "u").select("owner", F.round("pvalue", 9).alias("pvalue"))


@query(f"""WITH {BAGS}, t AS (SELECT DISTINCT p AS t FROM bags UNION ALL SELECT max(p) + 1e-9 FROM bags), n AS (SELECT sum(target) AS np, count(*) - sum(target) AS nn FROM bags), x AS (SELECT t, round((count(*) FILTER (p >= t AND target = 1) / CAST(max(np) AS DOUBLE) + count(*) FILTER (p < t AND target = 0) / CAST(max(nn) AS DOUBLE)) / 2, 12) AS ba,
round(count(*) FILTER (p < t AND target = 0) / CAST(max(nn) AS DOUBLE), 12) AS spec FROM t, bags, n GROUP BY t) SELECT round(t, 6) AS threshold, round(ba, 6) AS balanced_accuracy, round(spec, 6) AS specificity FROM x ORDER BY ba DESC, spec DESC, t DESC LIMIT 1""")
def development_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ops.best_threshold(bags(spark, sf_dir), "p", "target")
    return t.select(*(F.round(c, 6).alias(c) for c in t.columns))


CURVE = """c AS (SELECT user_id AS run, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, arg_max(value, event_id) / 1000.0::DOUBLE AS g, arg_max(event_id % 97, event_id) / 97.0::DOUBLE AS s FROM events GROUP BY 1, 2)"""
RANK = "rank() OVER (PARTITION BY run ORDER BY {c}) + (count(*) OVER (PARTITION BY run, {c}) - 1) / 2.0::DOUBLE"


@query(f"""WITH {CURVE}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS r, count(*) OVER (PARTITION BY run) AS n FROM c), k AS (SELECT run, {RANK.format(c="g")} AS a, {RANK.format(c="s")} AS b FROM n WHERE r > ceil(.3::DOUBLE * n)),
rho AS (SELECT run, CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS rho FROM k GROUP BY run), a AS (SELECT run, arg_max(epoch, (g, -epoch)) AS chosen, max(g) AS g, arg_max(s, (g, -epoch)) AS s, max(s) AS best FROM c GROUP BY run)
SELECT a.run, chosen, round(g, 6) AS g, round(s, 6) AS s, round(best - s, 6) AS regret, round(rho, 6) AS rho, round(.35 * g + .45 * s + .2 * (.7 * (1 - least((best - s) / .2, 1)) + .3 * (coalesce(rho, 0) + 1) / 2), 6) AS w FROM a LEFT JOIN rho ON a.run = rho.run""")
def selection_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("epoch"), "event_id", "value")
    c = e.groupBy("run", "epoch").agg((F.max_by("value", "event_id") / 1000).alias("g"), (F.max_by(F.col("event_id") % 97, F.col("event_id")) / F.lit(97.0)).alias("s"))
    out = ops.coupling(c, ["run"], "epoch", "g", "s")
    return out.select("run", "chosen", *(F.round(x, 6).alias(x) for x in ("g", "s", "regret", "rho", "w")))


@query(f"""WITH RECURSIVE {RUNS}, o AS (SELECT trial, metric, row_number() OVER (PARTITION BY trial ORDER BY attempt) AS r FROM runs), e(trial, r, m) AS (SELECT trial, r, metric FROM o WHERE r = 1 UNION ALL SELECT o.trial, o.r, .9 * e.m + .1 * o.metric FROM e JOIN o ON o.trial = e.trial AND o.r = e.r + 1)
SELECT trial, round(arg_max(m, r), 5) AS ema FROM e GROUP BY trial""")
def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.moving_average(runs(spark, sf_dir), ["trial"], "attempt", "metric", 0.9).select("trial", F.round("ema", 5).alias("ema"))


@query(f"""WITH RECURSIVE {RUNS}, o AS (SELECT trial, metric AS u, CAST(seed AS DOUBLE) / 7 AS g, row_number() OVER (PARTITION BY trial ORDER BY attempt) AS r FROM runs), e(trial, r, h) AS (SELECT trial, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM o WHERE r = 1 UNION ALL SELECT o.trial, o.r, o.g * e.h + (1 - o.g) * o.u FROM e JOIN o ON o.trial = e.trial AND o.r = e.r + 1)
SELECT trial, round(arg_max(h, r), 5) AS state FROM e GROUP BY trial""")
def gated_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("g", F.col("seed").cast("double") / 7)
    return ops.gated_scan(r, ["trial"], "attempt", "g", "metric").select("trial", F.round("state", 5).alias("state"))


@query(f"""WITH RECURSIVE {BAGS}, l AS (SELECT list(p) AS ps FROM bags), b(i, low, high) AS (SELECT 0, -30.0::DOUBLE, 30.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN m < .2 THEN mid ELSE low END, CASE WHEN m < .2 THEN high ELSE mid END FROM (SELECT i, low, high, (low + high) / 2 AS mid, list_avg(list_transform(ps, lambda x: 1 / (1 + exp(-(x + (low + high) / 2))))) AS m FROM b, l WHERE i < 64)),
c AS (SELECT (low + high) / 2 AS bias FROM b WHERE i = 64) SELECT round(bias, 9) AS bias, round(avg(1 / (1 + exp(-(p + bias)))), 6) AS mean FROM bags, c GROUP BY bias""")
def prevalence_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bags(spark, sf_dir)
    bias = ops.matching_bias(b, "p", 0.2)
    return b.agg(F.lit(round(bias, 9)).alias("bias"), F.round(F.avg(1 / (1 + F.exp(-(F.col("p") + bias)))), 6).alias("mean"))


CURVE2 = """c AS (SELECT user_id % 20 AS run, event_type AS stratum, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, arg_max(value, event_id) / 1000.0::DOUBLE AS g, arg_max(event_id % 97, event_id) / 97.0::DOUBLE AS s FROM events GROUP BY 1, 2, 3)"""


@query(f"""WITH {CURVE2}, a AS (SELECT run, stratum, arg_max(epoch, (g, -epoch)) AS chosen, max(g) AS g, arg_max(s, (g, -epoch)) AS s, max(s) AS best FROM c GROUP BY run, stratum) SELECT run, stratum, chosen, round(g, 6) AS g, round(s, 6) AS s, round(best - s, 6) AS regret FROM a""")
def subgroup_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("event_type").alias("stratum"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("epoch"), "event_id", "value")
    c = e.groupBy("run", "stratum", "epoch").agg((F.max_by("value", "event_id") / 1000).alias("g"), (F.max_by(F.col("event_id") % 97, F.col("event_id")) / F.lit(97.0)).alias("s"))
    return ops.coupling(c, ["run", "stratum"], "epoch", "g", "s").select("run", "stratum", "chosen", *(F.round(x, 6).alias(x) for x in ("g", "s", "regret")))


@query(f"""WITH {BAGS}, c AS (SELECT family, count(*) FILTER (p >= .5 AND target = 1)::DOUBLE AS a, count(*) FILTER (p >= .5 AND target = 0)::DOUBLE AS b, count(*) FILTER (p < .5 AND target = 0)::DOUBLE AS e, count(*) FILTER (p < .5 AND target = 1)::DOUBLE AS f FROM bags GROUP BY family)
SELECT family, round(coalesce(((a * e - b * f) / nullif(sqrt(a + b) * sqrt(a + f) * sqrt(e + b) * sqrt(e + f), 0) + 1) / 2, 0), 6) AS objective FROM c""")
def mcc_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagweave.operators.bags import binary_metrics, confusion

    m = binary_metrics(confusion(bags(spark, sf_dir), ["family"]))
    return m.select("family", F.round(F.coalesce((F.col("mcc") + 1) / 2, F.lit(0.0)), 6).alias("objective"))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT url, max(octet_length(encode(html))) AS n FROM pages GROUP BY url)")
def storage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.max(F.octet_length("html")).cast("long").alias("n")).agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


@query(f"WITH {RUNS} SELECT seed AS epoch, status AS name, round(avg(metric), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY 1, 2")
def epoch_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy(F.col("seed").alias("epoch"), F.col("status").alias("name")).agg(F.round(F.avg("metric"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS site FROM lineitem), n AS (SELECT o_orderkey AS id, 1 + o_custkey % 7 AS site FROM orders) SELECT n.id, n.site FROM n LEFT JOIN s ON s.id = n.id AND s.site = n.site WHERE s.id IS NULL""")
def unexplained_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagweave.operators.descriptors import unexplained_sites as unexplained

    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("site"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % 7).alias("site"))
    return unexplained(sites, notes, ["id", "site"])


@query(f"""WITH {BAGS}, g AS (SELECT family, sum(CASE WHEN target = 1 THEN p ELSE 0 END) AS cost, exp(sum(ln(greatest(u, 1e-6)))) AS open FROM bags GROUP BY family) SELECT family, round(cost * open + 1e-11, 8) AS contribution FROM g""")
def gate_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bags(spark, sf_dir).groupBy("family").agg(F.sum(F.when(F.col("target") == 1, F.col("p")).otherwise(0.0)).alias("cost"), F.exp(F.sum(F.log(F.greatest("u", F.lit(1e-6))))).alias("open"))
    return g.select("family", F.round(F.col("cost") * F.col("open") + 1e-11, 8).alias("contribution"))
