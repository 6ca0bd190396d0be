"""Quality of a surface: how far its points lie from the envelope of expanded spheres, and how its normals agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.operators.spatial import XYZ, near_pairs

#: A normal's least cosine, and the tolerance of a gap as a share of the resolution, with its floor.
LEAST_COSINE, GAP_SHARE, GAP_FLOOR = 0.99, 0.025, 5e-4


def alignment(points: DataFrame, spheres: DataFrame, by: str, key: str, largest: float, probe: float, resolution: float) -> DataFrame:
    """by, key, gap (least signed distance to an expanded sphere of the structure, null without one in reach) and cosine (of the normal with the blended gradient, 0 without).

    Spheres within the largest expanded radius and the resolution take part. The gradients of those whose gap is near the least, within 2.5
    widths, are blended by exp(-excess / width); the width is a quarter of the resolution, 0.001 at least. Each point's pairs meet by
    its key; there are as many as spheres in reach.
    """
    width = max(resolution / 4, 1e-3)
    pairs = near_pairs(points, spheres, largest + probe + resolution, F.col(f"a_{by}") == F.col(f"b_{by}"))
    gap = F.col("d") - (F.col("b_radius") + probe)
    lean = pairs.select(F.col(f"a_{by}").alias(by), F.col(f"a_{key}").alias(key), gap.alias("g"), *((F.col(f"a_{c}") - F.col(f"b_{c}")) / F.greatest("d", F.lit(1e-12)) for c in XYZ), *(F.col(f"a_n{c}") for c in XYZ))
    lean = lean.toDF(by, key, "g", *(f"r{c}" for c in XYZ), *(f"n{c}" for c in XYZ)).withColumn("least", F.min("g").over(Window.partitionBy(by, key)))
    weight = F.exp(-(F.col("g") - F.col("least")) / width)
    sums = lean.filter(F.col("g") <= F.col("least") + 2.5 * width).groupBy(by, key).agg(F.first("least").alias("gap"), *(F.sum(weight * F.col(f"r{c}")).alias(f"e{c}") for c in XYZ), *(F.first(f"n{c}").alias(f"n{c}") for c in XYZ))
    length = F.sqrt(sum(F.col(f"e{c}") * F.col(f"e{c}") for c in XYZ))
    found = sums.select(by, key, "gap", (sum(F.col(f"e{c}") * F.col(f"n{c}") for c in XYZ) / F.greatest(length, F.lit(1e-12))).alias("cosine"))
    return points.select(by, key).join(found, [by, key], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def envelope_report(aligned: DataFrame, by: str, resolution: float) -> DataFrame:
    """Of each structure the extremes of gaps and cosines, and its points inside the envelope, off it (or out of reach), and turned."""
    tolerance = max(GAP_FLOOR, GAP_SHARE * resolution)
    gap = F.col("gap")
    return aligned.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"), F.min(gap).alias("least_gap"), F.max(gap).alias("largest_gap"), F.max(F.abs(gap)).alias("widest_gap"), F.min("cosine").alias("least_cosine"), F.avg("cosine").alias("mean_cosine"),
        F.count_if(gap < -tolerance).alias("inside"), F.count_if(gap.isNull() | (gap > tolerance)).alias("off"), F.count_if(F.col("cosine") < LEAST_COSINE).alias("turned"),
    )


def curvature_faults(rows: DataFrame, by: str, mean: str, gaussian: str, curvedness: str, radius: float, most: float = 25.0) -> DataFrame:
    """Of each structure the points whose curvatures break c^2 = 2 h^2 - k (within 2e-4 of the right side and 2e-6), those of an unstable fit (c radius > most), and the largest c radius."""
    right = 2 * F.col(mean) * F.col(mean) - F.col(gaussian)
    breaks = F.abs(F.col(curvedness) * F.col(curvedness) - right) > F.lit(2e-6) + 2e-4 * F.abs(right)
    size = F.col(curvedness) * radius
    return rows.groupBy(by).agg(F.count_if(breaks).alias("broken"), F.count_if(size > most).alias("unstable"), F.max(size).alias("largest"))
