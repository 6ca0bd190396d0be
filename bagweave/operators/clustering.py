"""Density clusters, shortcut baseline and principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.functions.lineage import cut
from bagweave.operators.neighbours import all_neighbours, spanning_tree
from bagweave.operators.strata import adjusted_rand

def density_tree(df: DataFrame, identifier: str, columns: Sequence[str], min_samples: int) -> DataFrame:
    """A minimum spanning tree of the population under mutual reachability: a, b, w. A member's core is the distance to its min_samples-th neighbour, or to its last."""
    own = df.select(identifier, *columns, F.lit(0).alias("_all"))
    cores = all_neighbours(own, "_all", identifier, columns, min_samples).groupBy("src").agg(F.max("d").alias("core"))
    rows = cut(own.join(cores.hint("merge"), F.col(identifier) == F.col("src"), "left").select(identifier, *columns, F.coalesce("core", F.lit(0.0)).alias("core")))
    return spanning_tree(rows, identifier, columns, "core")


def condensed_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, sizes: Sequence[int]) -> list[np.ndarray]:
    """Of a tree's edges between 0..n-1 in order of weight: for each least size the clusters of most excess of mass (-1 is noise).

    Merges of one weight are one merge of all that they join, so the order of equal edges doesn't count.
    """
    top = list(range(n))  # of a component the node that stands for it, by union-find over members
    parent, height, size = list(range(n)), [0.0] * n, [1] * n
    kids: list[list[int]] = [[] for _ in range(n)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y, weight in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        x, y = root(x), root(y)
        p, q = top[x], top[y]
        parent[y] = x
        joined = [k for node in (p, q) for k in (kids[node] if node >= n and height[node] == weight else [node])]
        top[x] = len(height)
        height.append(weight)
        size.append(size[p] + size[q])
        kids.append(joined)
    whole = top[root(0)] if n else -1
    start = [0] * len(height)
    stack = [whole] if n else []
    while stack:
        node = stack.pop()
        at = start[node]
        for k in kids[node]:
            start[k] = at
            at += size[k]
            stack.append(k)
    at = np.array(start[:n])
    return [labelled(whole, kids, height, size, start, n, least)[at] if n else np.zeros(0, int) for least in sizes]


def labelled(whole: int, kids: list, height: list, size: list, start: list, n: int, least: int) -> np.ndarray:
    """The clusters of one least size, by places of members in the order of the tree."""
    owner = np.zeros(n, int)
    stability, children, birth = [0.0], [[]], [0.0]
    todo = [(whole, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        rate = 1 / max(height[node], 1e-12)
        big = [k for k in kids[node] if size[k] >= least]
        if len(big) == 1:
            stability[c] += (size[node] - size[big[0]]) * (rate - birth[c])
            todo.append((big[0], c))
            continue
        stability[c] += size[node] * (rate - birth[c])
        for k in big:
            owner[start[k] : start[k] + size[k]] = len(birth)
            children[c].append(len(birth))
            todo.append((k, len(birth)))
            birth.append(rate)
            stability.append(0.0)
            children.append([])
    value = [0.0] * len(birth)
    chosen = [False] * len(birth)
    for c in range(len(birth) - 1, -1, -1):
        below = sum(value[k] for k in children[c])
        chosen[c] = c > 0 and stability[c] >= below
        value[c] = max(stability[c], below) if c else below
    label, names = np.full(len(birth), -1), 0
    above = {k: c for c, ks in enumerate(children) for k in ks}
    for c in range(1, len(birth)):  # a cluster's number is larger than its parent's
        if label[above[c]] >= 0:
            label[c] = label[above[c]]
        elif chosen[c]:
            label[c], names = names, names + 1
    return label[owner] if names > 1 else np.full(n, -1)


def tree_clusters(tree: DataFrame, kind: str, sizes: Sequence[int]) -> DataFrame:
    """id, least, cluster (by order of their least members, null for noise) of every end of a tree's edges, for each least size.

    Merging goes edge by edge, so the edges pass through one task in order of weight, some 100 bytes each; neighbours and tree come from all tasks.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        if not rows.num_rows:
            return
        ends = [rows.column(c).combine_chunks() for c in ("a", "b")]
        ids = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ends]))
        a, b = (np.searchsorted(ids, x.to_numpy(zero_copy_only=False)) for x in ends)
        for least, found in zip(sizes, condensed_labels(a, b, rows.column("w").to_numpy(), len(ids), sizes), strict=True):
            seen, first = np.unique(found, return_index=True)
            order = np.argsort(np.argsort(first[seen >= 0]))
            names = np.append(order, -1)  # of cluster 0.. and of noise
            cluster = names[found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, ends[0].type), pa.array(np.full(len(ids), least, np.int32)), pa.array(cluster, pa.int64(), mask=cluster < 0)], ["id", "least", "cluster"])

    return tree.repartition(1).sortWithinPartitions("w").mapInArrow(label, f"id {kind}, least int, cluster long")


def phenotypes(df: DataFrame, identifier: str, columns: Sequence[str], prefix: str, min_cluster: int, min_samples: int) -> DataFrame:
    """identifier, phenotype: prefix001.. by the clusters' least members, prefix_NOISE otherwise.

    Rows with a null or not finite value are noise, and so is everyone if fewer than 2 min_cluster rows are complete or fewer than two clusters come out.
    """
    whole = complete(df, columns)
    labels = tree_clusters(density_tree(whole, identifier, columns, min_samples), df.schema[identifier].dataType.simpleString(), [min_cluster])
    enough = whole.count() >= 2 * min_cluster
    name = F.when(F.col("cluster").isNotNull() & F.lit(enough), F.format_string(f"{prefix}%03d", F.col("cluster") + 1)).otherwise(f"{prefix}_NOISE")
    return df.select(identifier).join(labels.withColumnRenamed("id", "_id"), F.col(identifier) == F.col("_id"), "left").select(identifier, name.alias("phenotype"))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values are all there and finite."""
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.filter(every)


def stable_phenotypes(df: DataFrame, identifier: str, columns: Sequence[str], prefix: str, sizes: Sequence[int], min_samples: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Clusters of the least size of a grid, kept only if those of every other size agree with them (adjusted Rand index, noise being a group):
    (identifier, phenotype), and one row of count, clusters, minimum_ari, noise_fraction, robust, reason.

    One tree serves the whole grid. A grid of fewer than two sizes within 2 and the population is no support; without at least two
    clusters, or with a lower agreement than the threshold, everyone is noise.
    """
    noise = df.select(identifier, F.lit(f"{prefix}_NOISE").alias("phenotype"))
    n = df.count()
    grid = sorted({s for s in sizes if 2 <= s <= n})
    spark = df.sparkSession
    schema = "count long, clusters long, minimum_ari double, noise_fraction double, robust boolean, reason string"
    if len(grid) < 2:
        return noise, spark.createDataFrame([(n, 0, None, 1.0, False, "insufficient_grid_support")], schema)
    spread = df.agg(*((F.max(c) - F.min(c)).alias(f"w{i}") for i, c in enumerate(columns))).first()
    kept = [c for i, c in enumerate(columns) if spread[f"w{i}"] > 1e-10]
    if not kept:
        return noise, spark.createDataFrame([(n, 0, None, 1.0, False, "constant_descriptors")], schema)
    labels = cut(tree_clusters(density_tree(df, identifier, kept, min_samples), df.schema[identifier].dataType.simpleString(), grid))
    own = labels.filter(F.col("least") == grid[0]).select("id", F.coalesce("cluster", F.lit(-1)).alias("one"))
    agreement = None
    for size in grid[1:]:
        both = own.join(labels.filter(F.col("least") == size).select("id", F.coalesce("cluster", F.lit(-1)).alias("two")).hint("merge"), "id")
        one = adjusted_rand(both, "one", "two")
        agreement = one if agreement is None else agreement.unionAll(one)
    least = agreement.agg(F.min("ari").alias("ari")).first()["ari"]
    clusters = own.filter("one >= 0").agg(F.countDistinct("one").alias("n")).first()["n"]
    robust = clusters >= 2 and least is not None and least >= threshold
    fraction = own.agg(F.avg((F.col("one") < 0).cast("double")).alias("f")).first()["f"] if robust else 1.0
    report = spark.createDataFrame([(n, clusters, least, fraction, robust, "stable_multicluster" if robust else "no_robust_multicluster_solution")], schema)
    if not robust:
        return noise, report
    name = F.when(F.col("one") >= 0, F.concat(F.lit(f"{prefix}_"), F.col("one").cast("string"))).otherwise(f"{prefix}_NOISE")
    return df.select(identifier).join(own.withColumnRenamed("id", "_id").hint("merge"), F.col(identifier) == F.col("_id")).select(identifier, name.alias("phenotype")), report


def shortcut_baseline(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], train: str) -> DataFrame:
    """Scores of a balanced logistic regression on shortcut features (median imputed, standardized, one-hot), fitted where ``train`` holds: rows with ``score``."""
    rows = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    fit = lambda t, d: t.fit(d.filter(train)).transform(d)
    rows = fit(Imputer(strategy="median", inputCols=list(numbers), outputCols=[f"{c}_i" for c in numbers]), rows)
    rows = fit(StandardScaler(inputCol="_n", outputCol="_z", withMean=True), VectorAssembler(inputCols=[f"{c}_i" for c in numbers], outputCol="_n").transform(rows))
    rows = fit(StringIndexer(inputCols=list(categories), outputCols=[f"{c}_x" for c in categories], handleInvalid="keep"), rows)
    rows = fit(OneHotEncoder(inputCols=[f"{c}_x" for c in categories], outputCols=[f"{c}_h" for c in categories], handleInvalid="keep"), rows)
    rows = VectorAssembler(inputCols=["_z", *(f"{c}_h" for c in categories)], outputCol="_f").transform(rows)
    n = rows.filter(train).groupBy(label).count().collect()
    total = sum(r["count"] for r in n)
    weights = F.coalesce(*(F.when(F.col(label) == r[label], F.lit(total / (len(n) * r["count"]))) for r in n), F.lit(1.0))
    model = LogisticRegression(featuresCol="_f", labelCol=label, weightCol="_w", regParam=1e-4, maxIter=50).fit(rows.withColumn("_w", weights).filter(train))
    out = model.transform(rows.withColumn("_w", weights))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def principal_components(df: DataFrame, values: str, k: int) -> DataFrame:
    """Adds ``components``: the first k principal components of an array column, signs fixed by the largest loading."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.transform(values, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), range(k)])
    return model.transform(rows).withColumn("components", F.zip_with(vector_to_array("_p"), F.array(*(F.lit(float(s)) for s in signs)), lambda a, b: a * b)).drop("_v", "_p")
