"""Structure queries: roles, bonds, residue graphs, sites, projections, views and per-structure kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.operators import envelopes
from bagweave.operators import structures as ops
from bagweave.operators.spatial import fibonacci_sphere, near_pairs
from bagweave.plans.registry import query
from bagweave.plans.spatial_queries import D2, near, others
from bagweave.plans.views import ATOMS, POINTS, atoms, points, table


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'hydrogen' WHEN p_brand = 'Brand#1' THEN 'metal' WHEN p_type = 'SMALL' THEN 'water' WHEN p_size < 5 THEN 'nonpolymer' WHEN p_size < 20 THEN 'backbone' ELSE 'sidechain' END AS role FROM part")
def atom_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select("p_partkey", ops.atom_role(F.when(size % 7 == 0, "H").otherwise("C"), F.col("p_brand") == "Brand#1", F.when(F.col("p_type") == "SMALL", "HOH").otherwise("ALA"), size >= 5, size < 20).alias("role"))


KINDS = "['single', 'double', 'triple', 'aromatic', 'none']"
BONDS = f"""bonds AS (SELECT l_partkey % 300 AS a, l_suppkey % 300 AS b, {KINDS}[1 + (l_linenumber % 5)] AS kind, ['explicit', 'template', 'peptide', 'disulfide', 'geometric'][1 + CAST(l_quantity AS INTEGER) % 5] AS source, l_discount * 25 + .5::DOUBLE AS length FROM lineitem WHERE l_partkey % 300 <> l_suppkey % 300)"""


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_partkey % 300 <> l_suppkey % 300")
    pick = lambda names, i: F.element_at(F.array(*(F.lit(n) for n in names)), (i + 1).cast("int"))
    return li.select((F.col("l_partkey") % 300).alias("a"), (F.col("l_suppkey") % 300).alias("b"), pick(ops.BOND_ORDERS, F.col("l_linenumber") % 5).alias("kind"), pick(ops.BOND_SOURCES, F.col("l_quantity").cast("int") % 5).alias("source"), (F.col("l_discount") * 25 + 0.5).alias("length"))


@query(f"""WITH {BONDS}, e AS (SELECT a AS x, kind FROM bonds UNION ALL SELECT b, kind FROM bonds), o AS (SELECT x, max(CASE kind WHEN 'single' THEN 1.0 WHEN 'double' THEN 2.0 WHEN 'triple' THEN 3.0 WHEN 'aromatic' THEN 1.5 ELSE 0.0 END) AS m FROM e GROUP BY x)
SELECT p_partkey, CAST(coalesce(m, 0) AS DOUBLE) AS max_order, CASE WHEN coalesce(m, 0) >= 3 THEN 'sp' WHEN coalesce(m, 0) >= 1.5 THEN 'sp2' WHEN coalesce(m, 0) > 0 THEN 'sp3' ELSE 'none' END AS state FROM part LEFT JOIN o ON x = p_partkey""")
def hybridization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hybridization(bonds(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", "max_order", "state")


@query(f"""WITH {BONDS}, k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, source, length, CASE source WHEN 'explicit' THEN 0 WHEN 'template' THEN 1 WHEN 'peptide' THEN 2 WHEN 'disulfide' THEN 3 ELSE 4 END AS r FROM bonds WHERE NOT (source = 'peptide' AND length > 1.9) AND NOT (source = 'disulfide' AND length > 2.3))
SELECT a, b, arg_min(source, (r, length, source)) AS source, round(arg_min(length, (r, length, source)), 6) AS length FROM k GROUP BY a, b""")
def bond_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.strongest_bonds(bonds(spark, sf_dir)).withColumn("length", F.round("length", 6))


@query(f"""WITH {ATOMS}, n AS (SELECT a.owner AS a, b.owner AS b, min(sqrt({D2})) AS d FROM atoms a JOIN atoms b ON a.owner < b.owner AND {D2} <= .09::DOUBLE GROUP BY 1, 2), u AS (SELECT a, b, d, 1 AS bit FROM n UNION ALL SELECT label, label + 1, NULL, 2 FROM (SELECT DISTINCT label FROM embeddings)) SELECT a, b, round(min(d), 6) AS d, bit_or(bit) AS relation FROM u GROUP BY a, b""")
def residue_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    known = a.select(F.col("owner").alias("a")).distinct().select("a", (F.col("a") + 1).alias("b"), F.lit(2).alias("bit"))
    return ops.residue_graph(a, 0.3, known).withColumn("d", F.round("d", 6))


@query(f"""WITH {ATOMS}, p AS (SELECT a.atom AS metal, b.owner AS o, .4::DOUBLE + (b.atom % 7) * .1::DOUBLE AS occ, sqrt({D2}) AS d FROM atoms a JOIN atoms b ON a.atom % 10 = 0 AND b.atom % 10 <> 0 AND {D2} <= 1.0::DOUBLE AND .4::DOUBLE + (b.atom % 7) * .1::DOUBLE >= .5),
g AS (SELECT metal, count(*) AS n, count(DISTINCT o) AS r, min(occ) AS low, max(d) AS far FROM p GROUP BY metal) SELECT metal, CAST(n AS BIGINT) AS donors, CAST(r AS BIGINT) AS residues, n >= 2 AND r >= 2 AS accepted, n >= 4 AND r >= 3 AND low >= .8 AND far <= 2.8 AS strong FROM g""")
def metal_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir).withColumn("occupancy", F.lit(0.4) + (F.col("atom") % 7) * F.lit(0.1))
    return ops.metal_sites(a.filter("atom % 10 = 0"), a.filter("atom % 10 != 0"), cutoff=1.0)


UNIT = "sqrt({s}.nx * {s}.nx + {s}.ny * {s}.ny + {s}.nz * {s}.nz)"


@query(f"""WITH {ATOMS}, e AS (SELECT a.atom AS a, b.atom AS b, sqrt({D2}) AS d, (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / ({UNIT.format(s="a")} * {UNIT.format(s="b")}) AS dot, abs((b.x - a.x) * a.nx + (b.y - a.y) * a.ny + (b.z - a.z) * a.nz) / {UNIT.format(s="a")} AS ca,
abs((b.x - a.x) * b.nx + (b.y - a.y) * b.ny + (b.z - a.z) * b.nz) / {UNIT.format(s="b")} AS cb FROM atoms a JOIN atoms b ON a.atom < b.atom AND {D2} <= 1.0::DOUBLE) SELECT a, b, round(d, 6) AS d FROM e WHERE d > 0 AND dot >= -.25 AND greatest(ca / d, cb / d) <= .8""")
def filtered_surface_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filtered_graph(atoms(spark, sf_dir), 1.0).withColumn("d", F.round("d", 6))


@query(f"""WITH {near(0.9)} SELECT a, b, round(exp(-d * d / 2 - (1 - (pa - pb)) / .5 - pow(pa - pb, 2) / (2 * .25)), 8) AS w FROM near WHERE a < b""")
def edge_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    gap = F.col("a_p") - F.col("b_p")
    return near_pairs(a, a, 0.9, F.col("a_atom") < F.col("b_atom")).select(F.col("a_atom").alias("a"), F.col("b_atom").alias("b"), F.round(ops.conductance(F.col("d"), gap, gap), 8).alias("w"))


@query(f"""WITH {ATOMS}, w AS (SELECT a.atom AS a, exp(-{D2} / 8) AS w, b.p AS p FROM atoms a JOIN atoms b ON a.owner <> b.owner AND {D2} <= 1.0::DOUBLE) SELECT atom, round(coalesce(sum(w * w.p), 0), 6) AS total, round(coalesce(sum(w * w.p) / sum(w), 0), 6) AS mean FROM atoms LEFT JOIN w ON w.a = atom GROUP BY atom""")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir)
    g = ops.gaussian_projection(a, a, 1.0, "p", keep=others())
    return g.select("atom", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT vec_id AS point, unnest(generate_series(0, 7)) AS mode, CAST(unnest(embedding[1:8]) AS DOUBLE) AS phi FROM embeddings), v AS (SELECT vec_id AS point, 1 + (vec_id % 3) AS mass, (vec_id % 11) / 10.0::DOUBLE AS x FROM embeddings), c AS (SELECT mode, sum(phi * mass * x) * exp(-(mode * .5::DOUBLE) * 1.5) AS c FROM m JOIN v USING (point) GROUP BY mode)
SELECT point, round(sum(phi * c), 6) AS x FROM m JOIN c USING (mode) GROUP BY point""")
def spectral_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    modes = e.select(F.col("vec_id").alias("point"), F.posexplode(F.slice("embedding", 1, 8)).alias("mode", "phi")).select("mode", (F.col("mode") * 0.5).alias("eigenvalue"), "point", F.col("phi").cast("double").alias("phi"))
    values = e.select(F.col("vec_id").alias("point"), (1 + F.col("vec_id") % 3).alias("mass"), ((F.col("vec_id") % 11) / F.lit(10.0)).alias("x"))
    return ops.spectral_diffusion(modes, values, 1.5).withColumn("x", F.round("x", 6))


@query(f"""WITH {POINTS}, n AS (SELECT owner, p + .01::DOUBLE AS a, q + .01::DOUBLE AS b FROM points), m AS (SELECT owner, a, b, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM n WINDOW w AS (PARTITION BY owner)), k AS (SELECT *, (p + q) / 2 AS m FROM m)
SELECT owner, round((sum(p * log2(p / m)) + sum(q * log2(q / m))) / 2, 6) AS js, round(sum(abs(p - q)) / 2, 6) AS tv, round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END, 5) AS pearson FROM k GROUP BY owner""")
def view_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("owner", (F.col("p") + 0.01).alias("a"), (F.col("q") + 0.01).alias("b"))
    return ops.view_agreement(p, ["owner"], "a", "b").select("owner", F.round("js", 6).alias("js"), F.round("tv", 6).alias("tv"), F.round("pearson", 5).alias("pearson"))


@query(f"""WITH {BONDS}, d AS (SELECT a AS src, b AS dst, kind FROM bonds UNION ALL SELECT b, a, kind FROM bonds), m AS (SELECT dst, kind, avg((src * 7 % 101) / 100.0::DOUBLE) AS m FROM d GROUP BY dst, kind) SELECT dst AS node, round(sum(CASE kind WHEN 'single' THEN .5 WHEN 'double' THEN 1.5 ELSE 0 END * m), 6) AS message FROM m GROUP BY dst""")
def relation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bonds(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("kind").alias("relation"))
    nodes = b.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("value", (F.col("node") * 7 % 101) / F.lit(100.0))
    return ops.relation_messages(b, nodes, {"single": 0.5, "double": 1.5}).withColumn("message", F.round("message", 6))


@query(f"""WITH {ATOMS}, n AS (SELECT k, 1 - (2 * k + 1) / 96.0::DOUBLE AS z FROM (SELECT unnest(generate_series(0, 95)) AS k)), u AS (SELECT k, sqrt(1 - z * z) * cos(k * pi() * (3 - sqrt(5))) AS x, sqrt(1 - z * z) * sin(k * pi() * (3 - sqrt(5))) AS y, z FROM n),
a AS (SELECT atom, k, atoms.x + (radius + .1) * u.x AS x, atoms.y + (radius + .1) * u.y AS y, atoms.z + (radius + .1) * u.z AS z FROM atoms, u), g AS (SELECT a.atom, count(DISTINCT k) AS gone FROM a JOIN atoms b ON a.atom <> b.atom AND sqrt({D2}) < b.radius + .1 - 1e-9 GROUP BY a.atom)
SELECT atoms.atom, round((1 - coalesce(gone, 0) / 96.0::DOUBLE) * 4 * pi() * (radius + .1) * (radius + .1), 6) AS area FROM atoms LEFT JOIN g ON g.atom = atoms.atom""")
def exposed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "region").filter("r_regionkey = 0").select("r_regionkey")
    area = ops.exposed_area(atoms(spark, sf_dir), fibonacci_sphere(one, 96).select("k", "x", "y", "z"), 0.1, 0.4, 96)
    return area.select("atom", F.round("area", 6).alias("area"))


@query()
def rigid_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = atoms(spark, sf_dir).select("owner", "x", "y", "z", (-F.col("y") + 1).alias("u"), F.col("x").alias("v"), (F.col("z") - 2).alias("w"))
    return ops.rigid_fits(a, "owner").select("owner", F.transform("rotation", lambda r: F.round(r, 6)).alias("rotation"), F.round("rmsd", 6).alias("rmsd"))


@query()
def surface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ops.surface_normals(atoms(spark, sf_dir).select("owner", "atom", "x", "y", "z"), "owner")
    return n.select("atom", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")))


@query()
def grid_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = atoms(spark, sf_dir).groupBy("owner", *(F.floor(F.col(c) / 0.8).cast("long").alias(f"c{c}") for c in "xyz")).agg((F.count("*") > 1).alias("filled"))
    return ops.outside_cells(cells, "owner")


@query(f"""WITH {ATOMS}, p AS (SELECT * FROM atoms WHERE atom % 2 = 0), s AS (SELECT * FROM atoms WHERE atom % 2 = 1), n AS (SELECT a.atom, a.owner, sqrt({D2}) - (b.radius + 0.3::DOUBLE) AS g, (a.x - b.x) / greatest(sqrt({D2}), 1e-12) AS rx, (a.y - b.y) / greatest(sqrt({D2}), 1e-12) AS ry, (a.z - b.z) / greatest(sqrt({D2}), 1e-12) AS rz, a.nx, a.ny, a.nz FROM p a JOIN s b ON a.owner = b.owner AND sqrt({D2}) <= 1.1::DOUBLE),
m AS (SELECT *, min(g) OVER (PARTITION BY atom) AS least FROM n), e AS (SELECT atom, any_value(least) AS gap, sum(exp(-(g - least) / 0.1::DOUBLE) * rx) AS ex, sum(exp(-(g - least) / 0.1::DOUBLE) * ry) AS ey, sum(exp(-(g - least) / 0.1::DOUBLE) * rz) AS ez, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz FROM m WHERE g <= least + 0.25::DOUBLE GROUP BY atom),
c AS (SELECT p.owner, p.atom, gap, coalesce((ex * e.nx + ey * e.ny + ez * e.nz) / greatest(sqrt(ex * ex + ey * ey + ez * ez), 1e-12), 0) AS cosine FROM p LEFT JOIN e USING (atom))
SELECT owner, CAST(count(*) AS BIGINT) AS points, round(min(gap), 6) AS least_gap, round(max(gap), 6) AS largest_gap, round(max(abs(gap)), 6) AS widest_gap, round(min(cosine), 6) AS least_cosine, round(avg(cosine), 6) AS mean_cosine, CAST(count(*) FILTER (gap < -0.01::DOUBLE) AS BIGINT) AS inside, CAST(count(*) FILTER (gap IS NULL OR gap > 0.01::DOUBLE) AS BIGINT) AS off, CAST(count(*) FILTER (cosine < 0.99::DOUBLE) AS BIGINT) AS turned FROM c GROUP BY owner""")
def surface_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of even numbers as points of a surface, those of odd numbers as its spheres."""
    a = atoms(spark, sf_dir)
    points = a.filter("atom % 2 = 0").select("owner", "atom", "x", "y", "z", "nx", "ny", "nz")
    found = envelopes.alignment(points, a.filter("atom % 2 = 1").select("owner", F.col("atom").alias("sphere"), "x", "y", "z", "radius"), "owner", "atom", 0.4, 0.3, 0.4)
    report = envelopes.envelope_report(found, "owner", 0.4)
    return report.select("owner", "points", *(F.round(c, 6).alias(c) for c in ("least_gap", "largest_gap", "widest_gap", "least_cosine", "mean_cosine")), "inside", "off", "turned")
