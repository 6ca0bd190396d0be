"""Distribution, strata and moment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions.ranged import exact_quantiles
from bagweave.functions.scalar import ratio
from bagweave.operators import strata as ops
from bagweave.plans.registry import query
from bagweave.plans.views import BAGS, POINTS, bags, points, table

r6 = lambda c: F.round(c, 6).alias(c)
DIST = "CAST(count({v}) AS BIGINT) AS n, CAST(min({v}) AS DOUBLE) AS min, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS sd, round(quantile_cont(CAST({v} AS DOUBLE), .5), 6) AS median, round(quantile_cont(CAST({v} AS DOUBLE), .25), 6) AS q25, round(quantile_cont(CAST({v} AS DOUBLE), .75), 6) AS q75, CAST(max({v}) AS DOUBLE) AS max"


@query(f"SELECT lang, {DIST.format(v='n_chars')} FROM documents GROUP BY lang")
def numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(*ops.distribution("n_chars"))
    return d.select("lang", "n", "min", r6("mean"), r6("sd"), r6("median"), r6("q25"), r6("q75"), "max")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS positive, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS negative FROM labels")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"))


@query("""SELECT doc_id % 3 AS split, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS groups, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS positive, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS de
FROM documents JOIN labels USING (doc_id) GROUP BY doc_id % 3""")
def split_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy((F.col("doc_id") % 3).alias("split")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("groups"), F.count_if(F.col("quality") == 1).alias("positive"), *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de")))


@query("""WITH g AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS groups, CAST(max(n) AS BIGINT) AS largest, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS singleton_fraction, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS largest_share FROM g""")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("singleton_fraction"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


@query("""WITH d AS (SELECT *, quality = 1 AS s FROM documents JOIN labels USING (doc_id)), w AS (SELECT n_chars AS v, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM d GROUP BY 1),
x AS (SELECT abs(sum(a) OVER r / CAST(sum(a) OVER () AS DOUBLE) - sum(b) OVER r / CAST(sum(b) OVER () AS DOUBLE)) * (lead(v) OVER (ORDER BY v) - v) AS gap FROM w WINDOW r AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
y AS (SELECT sum(gap) AS distance FROM x)
SELECT round((avg(n_chars) FILTER (s) - avg(n_chars) FILTER (NOT s)) / sqrt((var_pop(n_chars) FILTER (s) + var_pop(n_chars) FILTER (NOT s)) / 2), 6) AS smd, round((avg(n_chars) FILTER (s) - avg(n_chars) FILTER (NOT s)) / sqrt((var_samp(n_chars) FILTER (s) + var_samp(n_chars) FILTER (NOT s)) / 2), 6) AS smd_sample,
abs((avg(n_chars) FILTER (s) - avg(n_chars) FILTER (NOT s)) / sqrt((var_samp(n_chars) FILTER (s) + var_samp(n_chars) FILTER (NOT s)) / 2)) >= .5 AS flagged, round(max(distance), 5) AS wasserstein FROM d, y""")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    side = F.col("quality") == 1
    one = d.agg(ops.standardized_difference(d, "n_chars", side)[0], *(c.alias(f"{n}_sample") for c, n in zip(ops.standardized_difference(d, "n_chars", side, sample=True)[:1], ["smd"], strict=True)))
    w = ops.wasserstein(d, "n_chars", side)
    return one.crossJoin(w).select(r6("smd"), r6("smd_sample"), (F.abs("smd_sample") >= 0.5).alias("flagged"), F.round("distance", 5).alias("wasserstein"))


QUART = f"""{BAGS}, c AS (SELECT quantile_cont(size, .25) AS a, quantile_cont(size, .5) AS b, quantile_cont(size, .75) AS d FROM bags), s AS (SELECT bags.*, CASE WHEN size <= a THEN 1 WHEN size <= b THEN 2 WHEN size <= d THEN 3 ELSE 4 END AS quartile FROM bags, c)"""
SCORES = """l AS (SELECT {k}, p, count(*) AS n, sum(target) AS tp FROM {t} GROUP BY ALL), w AS (SELECT *, n - tp AS neg, coalesce(sum(n - tp) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
sum(n) OVER d AS cn, sum(tp) OVER d AS ctp FROM l WINDOW d AS (PARTITION BY {k} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), z AS (SELECT {k}, CAST(sum(n) AS BIGINT) AS members, round(.3 * sum(tp * (lower + neg / 2.0::DOUBLE)) / nullif(sum(tp) * sum(neg), 0) + .7 * sum(tp * ctp / CAST(cn AS DOUBLE)) / nullif(sum(tp), 0) + 1e-9, 6) AS score FROM w GROUP BY {k})"""


@query(f"WITH {QUART}, {SCORES.format(k='quartile', t='s')} SELECT * FROM z WHERE members >= 8")
def quartile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.subgroup_scores(ops.quartile_strata(bags(spark, sf_dir), "size"), "quartile").select("quartile", "members", r6("score"))


@query(f"WITH {BAGS}, {SCORES.format(k='family', t='bags')} SELECT * FROM z WHERE members >= 8")
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.subgroup_scores(bags(spark, sf_dir), "family").select("family", "members", F.round(F.col("score") + 1e-9, 6).alias("score"))  # 1e-9: exact halves on one side


@query(f"""WITH {POINTS}, r AS (SELECT region, p, q, p - q AS e FROM points) SELECT region, CAST(count(*) AS BIGINT) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(corr(p, q), 6) AS pearson,
round(avg(CASE WHEN abs(q) > .1 THEN CASE WHEN sign(p) = sign(q) THEN 1.0::DOUBLE ELSE 0 END END), 6) AS sign_accuracy FROM r GROUP BY ROLLUP (region)""")
def regression_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.regression_metrics(points(spark, sf_dir), "p", "q", "region").select("region", "n", r6("mae"), r6("rmse"), r6("pearson"), r6("sign_accuracy"))


@query("""WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, .25) AS a, quantile_cont(l_extendedprice, .75) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS outside FROM lineitem JOIN q ON f = l_returnflag WHERE l_extendedprice < a - .75 * (b - a) OR l_extendedprice > b + .75 * (b - a) GROUP BY 1""", name="fence_warnings_narrow")
def fence_warnings_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    q = exact_quantiles(df, ["l_returnflag"], "l_extendedprice", {"low": 0.25, "high": 0.75})
    spread = F.col("high") - F.col("low")
    return df.join(F.broadcast(q), "l_returnflag").filter((F.col("l_extendedprice") < F.col("low") - 0.75 * spread) | (F.col("l_extendedprice") > F.col("high") + 0.75 * spread)).groupBy("l_returnflag").agg(F.count("*").alias("outside"))


@query("""WITH q AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), .25) AS a, quantile_cont(CAST(n_chars AS DOUBLE), .75) AS b FROM documents GROUP BY 1)
SELECT doc_id, lang, n_chars FROM documents JOIN q USING (lang) WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)""")
def fence_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fences(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"]).select("doc_id", "lang", "n_chars")


@query("""WITH s AS (SELECT 1 AS stage, 'document' AS unit, count(*) AS n FROM documents UNION ALL SELECT 2, 'document', count(*) FROM documents WHERE n_chars >= 500 UNION ALL SELECT 3, 'document', count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' UNION ALL SELECT 4, 'label', count(*) FROM labels)
SELECT stage, unit, CAST(n AS BIGINT) AS n, round(CASE WHEN lag(unit) OVER (ORDER BY stage) = unit THEN n / CAST(lag(n) OVER (ORDER BY stage) AS DOUBLE) END, 6) AS retained FROM s""")
def curation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("a"), F.count_if(F.col("n_chars") >= 500).alias("b"), F.count_if((F.col("n_chars") >= 500) & (F.col("lang") == "en")).alias("c"))
    both = d.crossJoin(table(spark, sf_dir, "labels").agg(F.count("*").alias("d")))
    stages = both.select(F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.lit("label" if c == "d" else "document").alias("unit"), F.col(c).alias("n")) for i, c in enumerate("abcd", 1)))).alias("s")).select("s.*")
    return ops.funnel(stages, "stage", "unit", "n").select("stage", "unit", "n", r6("retained"))


@query("""WITH d AS (SELECT lang AS a, doc_id % 4 AS b FROM documents), c AS (SELECT CAST(sum(n * (n - 1) / 2.0::DOUBLE) AS DOUBLE) AS x FROM (SELECT count(*) AS n FROM d GROUP BY a, b)), l AS (SELECT CAST(sum(n * (n - 1) / 2.0::DOUBLE) AS DOUBLE) AS y, sum(n) AS t FROM (SELECT count(*) AS n FROM d GROUP BY a)),
r AS (SELECT CAST(sum(n * (n - 1) / 2.0::DOUBLE) AS DOUBLE) AS z FROM (SELECT count(*) AS n FROM d GROUP BY b)) SELECT round((x - y * z / (t * (t - 1) / 2.0::DOUBLE)) / ((y + z) / 2 - y * z / (t * (t - 1) / 2.0::DOUBLE)), 6) AS ari FROM c, l, r""")
def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("a"), (F.col("doc_id") % 4).alias("b"))
    return ops.adjusted_rand(d, "a", "b").select(r6("ari"))


UNNEST = "SELECT vec_id, unnest(generate_series(0, 63)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


@query(f"""SELECT CAST(channel AS INTEGER) AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, CAST(count(*) FILTER (v = 0) AS BIGINT) AS zeros, min(v) AS min, max(v) AS max FROM ({UNNEST}) GROUP BY channel""")
def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fit_moments(table(spark, sf_dir, "embeddings"), "embedding").select("channel", r6("mean"), r6("sd"), "zeros", "min", "max")


@query(f"""WITH x AS ({UNNEST}), m AS (SELECT channel, avg(v) AS mu, stddev_pop(v) AS sd FROM x WHERE vec_id % 5 < 4 GROUP BY channel) SELECT vec_id, round(avg((v - mu) / (sd + 1e-6)), 5) AS mean_z, round(max((v - mu) / (sd + 1e-6)), 5) AS max_z FROM x JOIN m USING (channel) GROUP BY vec_id""")
def feature_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    z = ops.normalized(e, "embedding", ops.fit_moments(e.filter("vec_id % 5 < 4"), "embedding"), "vec_id")
    return z.groupBy("vec_id").agg(F.round(F.avg("z"), 5).alias("mean_z"), F.round(F.max("z"), 5).alias("max_z"))


@query("WITH " + ", ".join(["x AS (SELECT embedding FROM embeddings)"]) + " " + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, round(corr(CAST(embedding[{i + 1}] AS DOUBLE), CAST(embedding[{j + 1}] AS DOUBLE)), 6) AS r FROM x" for i in range(6) for j in range(i + 1, 6)))
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.correlations(table(spark, sf_dir, "embeddings"), "embedding", 6).select("a", "b", r6("r"))


@query("""WITH s AS (SELECT quantile_cont(abs(l_extendedprice - 30000), .5) AS m FROM lineitem), x AS (SELECT l_orderkey % 4 AS split, asinh((l_extendedprice - 30000) / m) AS v FROM lineitem, s), f AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM x WHERE split < 3)
SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg((v - mu) / sd), 5) AS mean_z FROM x, f GROUP BY split""")
def target_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("split"), (F.col("l_extendedprice") - 30000).alias("v"))
    middle = exact_quantiles(x.select(F.abs("v").alias("size")), [], "size", {"m": 0.5})
    x = x.crossJoin(F.broadcast(middle)).select("split", F.asinh(F.col("v") / F.col("m")).alias("v"))
    fit = x.filter("split < 3").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    return x.crossJoin(F.broadcast(fit)).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("v") - F.col("mu")) / F.col("sd")), 5).alias("mean_z"))


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT round(quantile_cont(CAST(n AS DOUBLE), .5), 6) AS q50, round(quantile_cont(CAST(n AS DOUBLE), .95), 6) AS q95, CAST(max(n) AS BIGINT) AS most,
round(avg(CASE WHEN n > 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_4, round(avg(CASE WHEN n > 8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_8, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty FROM c""")
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    q = lambda p: F.round(F.percentile(F.col("n").cast("double"), F.lit(p)), 6)
    return c.agg(q(0.5).alias("q50"), q(0.95).alias("q95"), F.max("n").alias("most"), *(F.round(F.avg((F.col("n") > k).cast("double")), 6).alias(f"above_{k}") for k in (4, 8)), F.count_if(F.col("n") == 0).alias("empty"))


@query("""WITH m AS (SELECT l_returnflag AS region, abs(l_discount - l_tax) <= .01 + .5 * abs(l_tax) AS ok FROM lineitem), r AS (SELECT region, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS c FROM m GROUP BY region) SELECT region, round(c, 6) AS agreement, (SELECT bool_and(c >= .3) FROM r) AS admitted FROM r""")
def agreement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), (F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.01 + 0.5 * F.abs("l_tax")).cast("double").alias("ok"))
    r = m.groupBy("region").agg(F.avg("ok").alias("c"))
    return r.crossJoin(r.agg(F.bool_and(F.col("c") >= 0.3).alias("admitted"))).select("region", F.round("c", 6).alias("agreement"), "admitted")


@query("""SELECT quality AS label, lang AS token, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n_chars IS NULL) AS BIGINT) AS missing FROM labels LEFT JOIN documents USING (doc_id) GROUP BY quality, lang""")
def diversity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left")
    return d.groupBy(F.col("quality").alias("label"), F.col("lang").alias("token")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars").isNull()).alias("missing"))


@query("""SELECT trial, seeds, mean, sd, signs FROM (WITH c AS (SELECT user_id % 30 AS trial, event_id % 7 AS seed, avg(CASE WHEN event_type = 'view' THEN value END) AS a, avg(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY 1, 2), d AS (SELECT trial, a - b AS x FROM c WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT trial, CAST(count(*) AS BIGINT) AS seeds, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd, CAST(count(*) FILTER (x > 0) AS BIGINT) AS signs FROM d GROUP BY trial)""")
def matched_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).alias("trial"), (F.col("event_id") % 7).alias("seed")).pivot("event_type", ["view", "click"]).agg(F.avg("value"))
    d = e.withColumn("x", F.col("view") - F.col("click")).filter("x is not null")
    return d.groupBy("trial").agg(F.count("*").alias("seeds"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_samp("x"), 5).alias("sd"), F.count_if(F.col("x") > 0).alias("signs"))


@query("""SELECT o_orderpriority AS stage, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS families, count(DISTINCT o_custkey) = count(*) AS independent, round(count(DISTINCT o_custkey) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM orders GROUP BY 1""")
def family_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("families"))
    return a.select("stage", "n", "families", (F.col("n") == F.col("families")).alias("independent"), F.round(ratio(F.col("families"), F.col("n")), 6).alias("ratio"))
