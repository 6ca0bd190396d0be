"""Spatial joins by cells: equal-sized cells, an equi-join on the 27 neighbours, then the exact distance.

No join here is a cross join; a cell holds the points of one volume, so the work follows local density. What only asks for the
nearest reads rings that grow up to its radius, so dense places are settled by small cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.lineage import cut

XYZ = ("x", "y", "z")
#: A ring settles what is this much nearer than its edge, so that rounding, to 32 bits too, hides nothing.
WITHIN = 1 - 1e-6


def cell(size: float | Column) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in XYZ]


def neighbour_cells(df: DataFrame, size: float, around: int = 1) -> DataFrame:
    """Each row once for each cell within ``around`` of its own."""
    shift = F.sequence(F.lit(-around), F.lit(around))
    for c in XYZ:
        df = df.withColumn(f"d{c}", F.explode(shift))
    return df.withColumns({f"c{c}": F.floor(F.col(c) / size).cast("long") + F.col(f"d{c}") for c in XYZ}).drop(*(f"d{c}" for c in XYZ))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keep: Column | None = None, spread: str = "left") -> DataFrame:
    """Pairs within the radius (inclusive): columns of left as a_*, of right as b_*, and d (their distance). The rows of ``spread`` go to all 27 cells."""
    own = lambda df: df.withColumns({f"c{c}": F.floor(F.col(c) / radius).cast("long") for c in XYZ})
    a, b = (neighbour_cells(left, radius), own(right)) if spread == "left" else (own(left), neighbour_cells(right, radius))
    a = a.select(*(F.col(c) if c in ("cx", "cy", "cz") else F.col(c).alias(f"a_{c}") for c in a.columns))
    b = b.select(*(F.col(c) if c in ("cx", "cy", "cz") else F.col(c).alias(f"b_{c}") for c in b.columns))
    d2 = sum((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in XYZ)
    pairs = a.join(b, ["cx", "cy", "cz"]).drop("cx", "cy", "cz").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    pairs = pairs.withColumn("d", F.sqrt("d2"))
    return pairs if keep is None else pairs.filter(keep)


def first_ring(rows: DataFrame, k: int, reach: float) -> float:
    """A radius in which some k rows lie about a row of a usual place, from one aggregate: 3.5 deviations stand for the width of an axis."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), *(F.stddev_pop(c).alias(c) for c in XYZ)).first()
    widths = [3.5 * r[c] for c in XYZ if r[c] is not None and 0 < r[c] < math.inf]
    if not widths:
        return reach
    return min(reach, max((math.prod(widths) * k / 4 / r["n"]) ** (1 / len(widths)), reach / 1024))


def by_rings(left: DataFrame, right: DataFrame, key: Sequence[str], first: float, reach: float, settled: Callable[[DataFrame, float, bool], DataFrame], keep: Column | None = None, spread: str = "left") -> DataFrame:
    """The rows of ``settled(pairs, ring, last)`` for the left rows (told apart by key), each from the first ring that settles it.

    Rings double from ``first`` to ``reach``. Only left rows without a settled row go on, so dense places are never read with large cells.
    """
    ring, out = first, None
    while True:
        last = ring >= reach
        done = cut(settled(near_pairs(left, right, min(ring, reach), keep, spread), ring, last))
        out = done if out is None else out.unionAll(done)
        if last:
            return out
        left = cut(left.join(done.select(*key).distinct(), list(key), "left_anti"))
        if left.isEmpty():
            return out
        ring *= 2


def few_of_place(rows: DataFrame, identifier: str, count: int, alike: Sequence[str] = ()) -> DataFrame:
    """Of the rows of one place (and of equal ``alike``) those of the ``count`` least ids: nobody's nearest are among the others."""
    least = F.row_number().over(Window.partitionBy(*XYZ, *alike).orderBy(identifier))
    return cut(rows.filter(" and ".join(f"{c} is not null" for c in XYZ)).withColumn("_r", least).filter(F.col("_r") <= count).drop("_r"))


def contacts(left: DataFrame, right: DataFrame, largest: float, slack: float = 0.5) -> DataFrame:
    """Pairs of spheres (radius column) that touch: distance strictly under the sum of radii and the slack."""
    reach = F.col("a_radius") + F.col("b_radius") + slack
    return near_pairs(left, right, 2 * largest + slack, F.col("d2") < reach * reach)


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int, left_id: str, right_id: str, self_join: bool = False, single: bool = False, keep: Column | None = None, alike: Sequence[str] | None = None) -> DataFrame:
    """The k nearest within the radius by (distance, id): left_id, right_id, d, rank from 1. ``single`` orders by 32-bit distances.

    ``alike`` names the columns of right, besides its id, that ``keep`` reads; with it, or without keep, a place that very many rows share is no hot cell.
    """
    a, b = f"a_{left_id}", f"b_{right_id}"
    there = right if keep is not None and alike is None else few_of_place(right, right_id, k + 1, alike or ())
    d, own = F.col("d").cast("float") if single else F.col("d"), Window.partitionBy("src")

    def settled(pairs: DataFrame, ring: float, last: bool) -> DataFrame:
        pairs = pairs.filter(F.col(a) != F.col(b)) if self_join else pairs
        pairs = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), "d")
        ranked = (pairs if last else pairs.filter(F.col("d") <= ring * WITHIN)).withColumn("rank", F.row_number().over(own.orderBy(d, "dst"))).filter(F.col("rank") <= k)
        return ranked if last else ranked.withColumn("got", F.count(F.lit(1)).over(own)).filter(F.col("got") == k).drop("got")

    here = left.withColumn("src", F.col(left_id))
    return by_rings(here, there, ["src"], first_ring(there, k, radius), radius, settled, keep)


def symmetric_ranks(neighbours: DataFrame) -> DataFrame:
    """Undirected pairs with the lesser of both ranks."""
    return neighbours.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("rank").alias("rank"), F.min("d").alias("d"))


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, least_cosine: float) -> DataFrame:
    """Pairs that are each other's nearest within the radius and whose normals (nx, ny, nz) agree: a, b, d, cosine."""
    there = nearest(left, right, radius, 1, left_id, right_id).select(F.col("src").alias("a"), F.col("dst").alias("b"), "d")
    back = nearest(right, left, radius, 1, right_id, left_id).select(F.col("dst").alias("a"), F.col("src").alias("b"))
    normals = lambda df, key, s: df.select(F.col(key).alias(s), *(F.col(f"n{c}").alias(f"{s}_n{c}") for c in XYZ))
    both = there.join(back, ["a", "b"]).join(normals(left, left_id, "a"), "a").join(normals(right, right_id, "b"), "b")
    dot = sum(F.col(f"a_n{c}") * F.col(f"b_n{c}") for c in XYZ)
    norm = lambda s: F.sqrt(sum(F.col(f"{s}_n{c}") * F.col(f"{s}_n{c}") for c in XYZ))
    return both.withColumn("cosine", dot / (norm("a") * norm("b"))).filter(F.col("cosine") >= least_cosine).select("a", "b", "d", "cosine")


def inverse_square_weights(neighbours: DataFrame) -> DataFrame:
    """Adds weight to (src, dst, d): 1 / d^2, normalized per src; exact coincidences take all of it."""
    w = Window.partitionBy("src")
    zero = F.max((F.col("d") == 0).cast("int")).over(w) == 1
    raw = F.when(zero, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d") * F.col("d")))
    return neighbours.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def exposed(points: DataFrame, spheres: DataFrame, largest: float, point_id: str, tolerance: float = 1e-5) -> DataFrame:
    """Points that lie strictly inside no sphere of another owner."""
    inside = near_pairs(points, spheres, largest, (F.col("d") < F.col("b_radius") - tolerance) & (F.col("a_owner") != F.col("b_owner"))).select(F.col(f"a_{point_id}").alias("gone")).distinct()
    return points.join(inside, F.col(point_id) == F.col("gone"), "left_anti")


def gaps(points: DataFrame, spheres: DataFrame, reach: float, point_id: str, keep: Column | None = None, alike: Sequence[str] | None = None) -> DataFrame:
    """Per point: the centre distance minus radius of the nearest centre, and the least over all spheres within reach.

    A ring settles a point if a sphere beyond it, were it of the largest radius, would be neither nearer nor less far. ``alike`` as in nearest().
    """
    there = spheres if keep is not None and alike is None else few_of_place(spheres, "atom", 1, ["radius", *(alike or ())])
    largest = there.agg(F.max("radius")).first()[0] or 0.0
    gap = F.col("d") - F.col("b_radius")

    def settled(pairs: DataFrame, ring: float, last: bool) -> DataFrame:
        own = pairs.groupBy(F.col(f"a_{point_id}").alias(point_id)).agg(F.min_by(gap, F.struct("d", "b_atom")).alias("nearest_gap"), F.min(gap).alias("least_gap"), F.min("d").alias("d"))
        seen = ring * WITHIN
        return (own if last else own.filter((F.col("d") <= seen) & (F.col("least_gap") <= seen - largest))).drop("d")

    return by_rings(points, there, [point_id], first_ring(there, 8, reach), reach, settled, keep)


def voxel_representatives(points: DataFrame, size: float, point_id: str) -> DataFrame:
    """The point nearest to each occupied cell's centre, the lower id on ties: cx, cy, cz, point_id, n."""
    d2 = sum(F.pow(F.col(c) - (F.floor(F.col(c) / size) + 0.5) * size, 2) for c in XYZ)
    return points.withColumn("d2", d2).groupBy(*cell(size)).agg(F.min_by(point_id, F.struct("d2", point_id)).alias(point_id), F.count("*").alias("n"))


def represented_area(neighbours: DataFrame) -> DataFrame:
    """src, area: the squared median distance to at most six neighbours, normalized to 1 over all points."""
    m = neighbours.filter("rank <= 6").groupBy("src").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    total = m.agg(F.sum(F.col("m") * F.col("m")).alias("t"))
    return m.crossJoin(F.broadcast(total)).select("src", (F.col("m") * F.col("m") / F.col("t")).alias("area"))


def fibonacci_sphere(ids: DataFrame, count: int) -> DataFrame:
    """Each id with ``count`` directions of a Fibonacci lattice: k, x, y, z."""
    rows = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    z = 1 - (2 * F.col("k") + 1) / F.lit(float(count))
    turn = F.col("k") * F.lit(3.141592653589793 * (3 - 5**0.5))
    r = F.sqrt(1 - z * z)
    return rows.select(*ids.columns, "k", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def morton_codes(df: DataFrame, bits: int = 10) -> DataFrame:
    """Adds code: the Z-order of the coordinates, scaled to their common extent (one aggregate row)."""
    box = df.agg(*(F.min(c).alias(f"lo_{c}") for c in XYZ), F.greatest(*(F.max(c) - F.min(c) for c in XYZ)).alias("extent"))
    q = {c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("extent") * (1 << bits)), F.lit((1 << bits) - 1)).cast("long") for c in XYZ}
    code = F.lit(0).cast("long")
    for i in range(bits):
        for j, c in enumerate(XYZ):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(q[c], i).bitwiseAND(1), 3 * i + j))
    return df.crossJoin(F.broadcast(box)).withColumn("code", code).drop("lo_x", "lo_y", "lo_z", "extent")


def pair_energy(queries: DataFrame, atoms: DataFrame, cutoff: float, overlap: float, query_id: str) -> DataFrame:
    """Lennard-Jones 12-6 sums over atoms within the cutoff (sigma the atom's radius doubled), masked where an atom overlaps."""
    s = F.col("b_radius") * 2
    p = near_pairs(queries, atoms, cutoff, F.col("d") > 0).withColumn("s6", F.pow(s / F.col("d"), F.lit(6.0)))
    a = p.groupBy(F.col(f"a_{query_id}").alias(query_id)).agg(F.sum(4 * (F.col("s6") * F.col("s6") - F.col("s6"))).alias("energy"), F.max((F.col("d") < overlap * s).cast("int")).alias("hit"))
    return a.select(query_id, F.when(F.col("hit") == 0, F.col("energy")).alias("energy"))
