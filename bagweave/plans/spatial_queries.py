"""Spatial queries over the embeddings' first coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.operators import spatial as ops
from bagweave.operators.graph import connected_components
from bagweave.plans.registry import query
from bagweave.plans.views import ATOMS, atoms

D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def others() -> Column:
    """Of pairs: those of different owners."""
    return F.col("a_owner") != F.col("b_owner")


def near(radius: float) -> str:
    return f"{ATOMS}, near AS (SELECT a.atom AS a, b.atom AS b, a.owner AS oa, b.owner AS ob, a.radius AS ra, b.radius AS rb, a.p AS pa, b.p AS pb, sqrt({D2}) AS d FROM atoms a JOIN atoms b ON a.atom <> b.atom AND {D2} <= {radius}::DOUBLE * {radius}::DOUBLE)"


KNN = near(1.0) + ", knn AS (SELECT * FROM (SELECT a AS src, b AS dst, d, pb, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM near) WHERE rank <= 8)"


@query(f"""WITH {near(1.3)} SELECT a AS atom, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT ob) AS BIGINT) AS partners FROM near WHERE oa < ob AND d * d < (ra + rb + .5) * (ra + rb + .5) GROUP BY a""")
def sphere_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    c = ops.contacts(a, a, 0.4).filter("a_owner < b_owner and a_atom != b_atom")
    return c.groupBy(F.col("a_atom").alias("atom")).agg(F.count("*").alias("pairs"), F.countDistinct("b_owner").alias("partners"))


@query(f"WITH {near(0.8)} SELECT a, b, round(d, 6) AS d FROM near WHERE b - a >= 3")
def radius_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.near_pairs(a, a, 0.8, F.col("b_atom") - F.col("a_atom") >= 3).select(F.col("a_atom").alias("a"), F.col("b_atom").alias("b"), F.round("d", 6).alias("d"))


@query(f"WITH {KNN} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(min(rank) AS INTEGER) AS rank FROM knn GROUP BY 1, 2")
def bounded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.symmetric_ranks(ops.nearest(a, a, 1.0, 8, "atom", "atom", self_join=True)).select("a", "b", "rank")


@query(f"""WITH {ATOMS}, near AS (SELECT a.atom AS src, b.atom AS dst, sqrt({D2}) AS d FROM atoms a JOIN atoms b ON a.owner <> b.owner AND {D2} <= 1.44::DOUBLE), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CAST(d AS FLOAT), dst) AS rank FROM near) SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.nearest(a, a, 1.2, 6, "atom", "atom", single=True, keep=others(), alike=["owner"]).select("src", "dst", "rank")


@query(f"""WITH {ATOMS}, n AS (SELECT a.atom AS a, b.atom AS b, sqrt({D2}) AS d, (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / (sqrt(a.nx * a.nx + a.ny * a.ny + a.nz * a.nz) * sqrt(b.nx * b.nx + b.ny * b.ny + b.nz * b.nz)) AS cosine FROM atoms a JOIN atoms b ON a.atom % 2 = 0 AND b.atom % 2 = 1 AND {D2} <= 1.0::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM n) SELECT a, b, round(d, 6) AS d, round(cosine, 6) AS cosine FROM r WHERE ra = 1 AND rb = 1 AND cosine >= -.2""")
def mutual_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.mutual_nearest(a.filter("atom % 2 = 0"), a.filter("atom % 2 = 1"), 1.0, "atom", "atom", -0.2).select("a", "b", F.round("d", 6).alias("d"), F.round("cosine", 6).alias("cosine"))


@query(f"WITH {KNN}, w AS (SELECT src, pb, CASE WHEN min(d) OVER (PARTITION BY src) = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0 END ELSE 1 / nullif(d * d, 0) END AS raw FROM knn) SELECT src, round(sum(raw * pb) / sum(raw), 6) AS value FROM w GROUP BY src")
def weighted_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    w = ops.inverse_square_weights(ops.nearest(a, a, 1.0, 8, "atom", "atom", self_join=True))
    return w.join(a.select(F.col("atom").alias("dst"), "p"), "dst").groupBy("src").agg(F.round(F.sum(F.col("weight") * F.col("p")), 6).alias("value"))


@query(f"WITH {ATOMS} SELECT atom FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM atoms b WHERE a.owner <> b.owner AND sqrt({D2}) < b.radius - 1e-5)")
def exposed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.exposed(a, a, 0.4, "atom").select("atom")


@query(f"""WITH {ATOMS}, n AS (SELECT a.atom AS a, b.atom AS b, sqrt({D2}) AS d, b.radius AS r FROM atoms a JOIN atoms b ON a.owner <> b.owner AND {D2} <= 2.25::DOUBLE) SELECT a AS atom, round(arg_min(d - r, (d, b)), 6) AS nearest_gap, round(min(d - r), 6) AS least_gap FROM n GROUP BY a""")
def sphere_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.gaps(a, a, 1.5, "atom", others(), ["owner"]).select("atom", F.round("nearest_gap", 6).alias("nearest_gap"), F.round("least_gap", 6).alias("least_gap"))


@query(f"""WITH {ATOMS}, v AS (SELECT *, CAST(floor(x / .9) AS BIGINT) AS cx, CAST(floor(y / .9) AS BIGINT) AS cy, CAST(floor(z / .9) AS BIGINT) AS cz FROM atoms) SELECT cx, cy, cz, arg_min(atom, (pow(x - (cx + .5::DOUBLE) * .9::DOUBLE, 2) + pow(y - (cy + .5::DOUBLE) * .9::DOUBLE, 2) + pow(z - (cz + .5::DOUBLE) * .9::DOUBLE, 2), atom)) AS atom, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY cx, cy, cz""")
def voxel_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.voxel_representatives(atoms(spark, sf_dir), 0.9, "atom")


@query(f"WITH {KNN}, m AS (SELECT src, quantile_cont(d, .5) AS m FROM knn WHERE rank <= 6 GROUP BY src) SELECT src, round(m * m / (SELECT sum(m * m) FROM m), 8) AS area FROM m")
def represented_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.represented_area(ops.nearest(a, a, 1.0, 8, "atom", "atom", self_join=True)).select("src", F.round("area", 8).alias("area"))


@query("""WITH k AS (SELECT r_regionkey, unnest(generate_series(0, 95)) AS k FROM region), s AS (SELECT r_regionkey, k, 1 - (2 * k + 1) / 96.0::DOUBLE AS z FROM k) SELECT r_regionkey, CAST(k AS INTEGER) AS k, round(sqrt(1 - z * z) * cos(k * pi() * (3 - sqrt(5))), 6) AS x, round(sqrt(1 - z * z) * sin(k * pi() * (3 - sqrt(5))), 6) AS y, round(z, 6) AS z FROM s""")
def sphere_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagweave.plans.views import table

    s = ops.fibonacci_sphere(table(spark, sf_dir, "region").select("r_regionkey"), 96)
    return s.select("r_regionkey", "k", *(F.round(c, 6).alias(c) for c in "xyz"))


MORTON = " | ".join(f"(((CAST(least(floor(({c} - lo{c}) / extent * 1024), 1023) AS BIGINT) >> {i}) & 1) << {3 * i + j})" for i in range(10) for j, c in enumerate("xyz"))


@query(f"""WITH {ATOMS}, b AS (SELECT min(x) AS lox, min(y) AS loy, min(z) AS loz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM atoms) SELECT atom, {MORTON} AS code, CAST(row_number() OVER (ORDER BY {MORTON}, atom) AS INTEGER) AS place FROM atoms, b""")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return ops.morton_codes(atoms(spark, sf_dir)).select("atom", "code", F.row_number().over(Window.orderBy("code", "atom")).alias("place"))


@query(f"""WITH {near(1.0)}, e AS (SELECT a, rb * 2 AS s, d, pow(rb * 2 / d, 6) AS s6 FROM near WHERE d > 0) SELECT a AS atom, round(CASE WHEN max(CASE WHEN d < .5 * s THEN 1 ELSE 0 END) = 0 THEN sum(4 * (s6 * s6 - s6)) END, 4) AS energy FROM e GROUP BY a""")
def probe_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    return ops.pair_energy(a, a, 1.0, 0.5, "atom").select("atom", F.round("energy", 4).alias("energy"))


REGIONS = near(0.7) + """, e AS (SELECT a, b FROM near WHERE pa >= .4 AND pb >= .4 AND oa = ob), reach(a, b) AS (SELECT atom, atom FROM atoms WHERE p >= .4 UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), c AS (SELECT a AS atom, min(b) AS region FROM reach GROUP BY a)"""


@query(f"""WITH RECURSIVE {REGIONS} SELECT c.region, CAST(count(*) AS BIGINT) AS points, arg_max(c.atom, (p, -c.atom)) AS anchor, max(p) AS score, round(sum(radius), 6) AS area, round(quantile_cont(p, .5), 6) AS median FROM c JOIN atoms ON c.atom = atoms.atom GROUP BY c.region""")
def superlevel_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir).filter("p >= 0.4")
    e = ops.near_pairs(a, a, 0.7, (F.col("a_owner") == F.col("b_owner")) & (F.col("a_atom") < F.col("b_atom")))
    comp = connected_components(e.select(F.col("a_atom").alias("src"), F.col("b_atom").alias("dst")))
    r = a.join(comp, F.col("atom") == F.col("id"), "left").withColumn("region", F.coalesce("component", "atom"))
    return r.groupBy("region").agg(F.count("*").alias("points"), F.max_by("atom", F.struct(F.col("p"), -F.col("atom"))).alias("anchor"), F.max("p").alias("score"), F.round(F.sum("radius"), 6).alias("area"), F.round(F.percentile("p", F.lit(0.5)), 6).alias("median"))


@query(f"""WITH {near(0.8)}, g AS (SELECT atoms.atom, count(near.b) AS degree FROM atoms LEFT JOIN near ON near.a = atoms.atom GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, CAST(count(*) FILTER (degree = 0) AS BIGINT) AS isolates, round(avg(degree), 6) AS mean_degree, CAST(max(degree) AS BIGINT) AS max_degree FROM g""")
def graph_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    n = ops.near_pairs(a, a, 0.8, F.col("a_atom") != F.col("b_atom")).groupBy("a_atom").agg(F.count("*").alias("degree"))
    g = a.join(n, F.col("atom") == F.col("a_atom"), "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return g.agg(F.count("*").alias("nodes"), F.floor(F.sum("degree") / 2).alias("edges"), F.count_if(F.col("degree") == 0).alias("isolates"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


@query(f"""WITH {near(0.9)}, w AS (SELECT a, b, pa, pb, exp(-d * d / (2 * .5 * .5)) AS w FROM near) SELECT a AS atom, round((max(pa) + .5 * sum(w * pb)) / (1 + .5 * sum(w)), 6) AS refined, round(sum(w * (pa - pb) * (pa - pb)), 6) AS variation FROM w GROUP BY a""")
def edge_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    w = ops.near_pairs(a, a, 0.9, F.col("a_atom") != F.col("b_atom")).withColumn("w", F.exp(-F.col("d") * F.col("d") / (2 * 0.5 * 0.5)))
    step = F.col("a_p") - F.col("b_p")
    return w.groupBy(F.col("a_atom").alias("atom")).agg(F.round((F.max("a_p") + 0.5 * F.sum(F.col("w") * F.col("b_p"))) / (1 + 0.5 * F.sum("w")), 6).alias("refined"), F.round(F.sum(F.col("w") * step * step), 6).alias("variation"))


@query(f"""WITH RECURSIVE {near(0.6)}, bfs(src, dst, depth) AS (SELECT atom, atom, 0 FROM atoms UNION SELECT bfs.src, near.b, bfs.depth + 1 FROM bfs JOIN near ON bfs.dst = near.a WHERE bfs.depth < 31) SELECT src, dst, min(depth) AS depth FROM bfs GROUP BY src, dst""")
def path_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagweave.operators.graph import near_depths

    return near_depths(atoms(spark, sf_dir), "atom", 0.6, 31)


@query(f"""WITH {near(0.8)}, g AS (SELECT near.a AS i, near.b AS j, exp(-d) AS v, pb FROM near) SELECT i AS atom, round(sum(v * pb), 6) AS product, round(sum(v), 6) AS mass FROM g GROUP BY i""")
def sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    g = ops.near_pairs(a, a, 0.8, F.col("a_atom") != F.col("b_atom")).select(F.col("a_atom").alias("atom"), F.exp(-F.col("d")).alias("v"), F.col("b_p").alias("x"))
    return g.groupBy("atom").agg(F.round(F.sum(F.col("v") * F.col("x")), 6).alias("product"), F.round(F.sum("v"), 6).alias("mass"))


@query(f"""WITH {ATOMS}, c AS (SELECT owner, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atoms GROUP BY owner), d AS (SELECT atoms.owner, n, (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz) AS d2 FROM atoms JOIN c ON atoms.owner = c.owner)
SELECT owner, CAST(max(n) AS BIGINT) AS n, round(sqrt(avg(d2)), 6) AS gyration, round(sqrt(avg(d2)) / pow(max(n), 1.0 / 3), 6) AS normalized, round(max(n) / (4.0 / 3 * pi() * pow(sqrt(avg(d2)), 3)), 5) AS compactness FROM d GROUP BY owner""")
def shape_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = atoms(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("g"))
    return g.select("owner", "n", F.round("g", 6).alias("gyration"), F.round(F.col("g") / F.pow(F.col("n"), F.lit(1 / 3)), 6).alias("normalized"), F.round(F.col("n") / (4 / 3 * 3.141592653589793 * F.pow("g", F.lit(3.0))), 5).alias("compactness"))


@query(f"""WITH {KNN}, d AS (SELECT src, dst, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, b.nx, b.ny, b.nz, sqrt(b.nx * b.nx + b.ny * b.ny + b.nz * b.nz) AS nn FROM knn JOIN atoms a ON a.atom = src JOIN atoms b ON b.atom = dst), e AS (SELECT *, (dx * nx + dy * ny + dz * nz) / nn AS h FROM d)
SELECT src, dst, round(h, 6) AS normal_offset, round(sqrt(greatest(0, dx * dx + dy * dy + dz * dz - h * h)), 5) AS tangential FROM e""")
def offset_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    k = ops.nearest(a, a, 1.0, 8, "atom", "atom", self_join=True)
    side = lambda s, key: a.select(F.col("atom").alias(key), *(F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")))
    d = k.join(side("a", "src"), "src").join(side("b", "dst"), "dst")
    diff = {c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"}
    norm = F.sqrt(sum(F.col(f"b_n{c}") * F.col(f"b_n{c}") for c in "xyz"))
    h = sum(diff[c] * F.col(f"b_n{c}") for c in "xyz") / norm
    return d.select("src", "dst", F.round(h, 6).alias("normal_offset"), F.round(F.sqrt(F.greatest(F.lit(0.0), sum(v * v for v in diff.values()) - h * h)), 5).alias("tangential"))
