"""Atoms, residues, bonds, metal sites and surfaces: lookups, precedence, contact graphs, projections and per-structure kernels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.lineage import cut
from bagweave.functions.scalar import pearson, ratio
from bagweave.operators.spatial import XYZ, by_rings, few_of_place, first_ring, near_pairs, neighbour_cells

#: Order of a bond by its category.
BOND_ORDERS = {"single": 1.0, "double": 2.0, "triple": 3.0, "aromatic": 1.5, "none": 0.0}
#: Rows of a block of directions, the least number of blocks, and cosines computed at once.
BLOCK, LEAST_BLOCKS, SLICE = 25_000, 8, 4_000_000
#: Paths of four computed at once, and tasks for each of the session's partitions, as few rows make much work there.
PATHS, FINER = 65_536, 8
#: Fixed value: evidence for a bond, strongest first.
BOND_SOURCES = ("explicit", "template", "peptide", "disulfide", "geometric")


def atom_role(element: Column, metal: Column, residue: Column, polymer: Column, backbone: Column) -> Column:
    """hydrogen, metal, water, nonpolymer, backbone, sidechain: the first that holds."""
    return F.when(element == "H", "hydrogen").when(metal, "metal").when(residue == "HOH", "water").when(~polymer, "nonpolymer").when(backbone, "backbone").otherwise("sidechain")


def hybridization(bonds: DataFrame, atoms: DataFrame, atom: str) -> DataFrame:
    """Adds max_order (0 without bonds) and state by thresholds on it. bonds: a, b, kind."""
    orders = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in BOND_ORDERS.items()), F.lit(0.0))
    ends = bonds.select(F.explode(F.array("a", "b")).alias("end"), orders.alias("o")).groupBy("end").agg(F.max("o").alias("m"))
    m = F.coalesce(F.col("m"), F.lit(0.0))
    return atoms.join(ends, F.col(atom) == F.col("end"), "left").withColumn("max_order", m).withColumn("state", F.when(m >= 3, "sp").when(m >= 1.5, "sp2").when(m > 0, "sp3").otherwise("none")).drop("end", "m")


def strongest_bonds(bonds: DataFrame) -> DataFrame:
    """One bond for each unordered pair (a, b, source, length): the strongest source that may hold; peptide bonds up to 1.9, disulfides up to 2.3."""
    rank = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(BOND_SOURCES)), F.lit(len(BOND_SOURCES)))
    ok = ~((F.col("source") == "peptide") & (F.col("length") > 1.9)) & ~((F.col("source") == "disulfide") & (F.col("length") > 2.3))
    kept = bonds.filter(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "source", "length", rank.alias("rank"))
    return kept.groupBy("a", "b").agg(F.min(F.struct("rank", "length", "source")).alias("m")).select("a", "b", F.col("m.source").alias("source"), F.col("m.length").alias("length"))


def residue_graph(atoms: DataFrame, radius: float, relations: DataFrame) -> DataFrame:
    """Residue pairs by their closest atoms within the radius, with relation bits or-ed (spatial is 1); related pairs stay beyond it.

    atoms: atom, owner (the residue), x, y, z; relations: a, b (residues), bit.
    """
    near = near_pairs(atoms, atoms, radius, F.col("a_owner") < F.col("b_owner")).groupBy(F.col("a_owner").alias("a"), F.col("b_owner").alias("b")).agg(F.min(F.struct("d", "a_atom", "b_atom")).alias("m"))
    near = near.select("a", "b", F.col("m.d").alias("d"), F.lit(1).alias("bit"))
    known = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("double").alias("d"), "bit")
    return near.unionAll(known).groupBy("a", "b").agg(F.min("d").alias("d"), F.bit_or("bit").alias("relation"))


def metal_sites(metals: DataFrame, donors: DataFrame, cutoff: float = 3.0, occupancy: float = 0.5, least_donors: int = 2, least_residues: int = 2) -> DataFrame:
    """Per metal: donors and residues within the cutoff, acceptance, and the strong tier (4 donors, 3 residues, occupancy .8, 2.8 away at most)."""
    p = near_pairs(metals, donors, cutoff, F.col("b_occupancy") >= occupancy)
    a = p.groupBy(F.col("a_atom").alias("metal")).agg(F.count("*").alias("donors"), F.countDistinct("b_owner").alias("residues"), F.min("b_occupancy").alias("low"), F.max("d").alias("far"))
    ok = (F.col("donors") >= least_donors) & (F.col("residues") >= least_residues)
    return a.select("metal", "donors", "residues", ok.alias("accepted"), (ok & (F.col("donors") >= 4) & (F.col("residues") >= 3) & (F.col("low") >= 0.8) & (F.col("far") <= 2.8)).alias("strong"))


def filtered_graph(points: DataFrame, reach: float, least_dot: float = -0.25, steep: float = 0.8) -> DataFrame:
    """Edges a < b within reach whose normals agree and whose chord isn't along either normal."""
    p = near_pairs(points, points, reach, F.col("a_atom") < F.col("b_atom"))
    unit = {s: F.sqrt(sum(F.col(f"{s}_n{c}") * F.col(f"{s}_n{c}") for c in XYZ)) for s in "ab"}
    dot = sum(F.col(f"a_n{c}") * F.col(f"b_n{c}") for c in XYZ) / (unit["a"] * unit["b"])
    chord = [F.abs(sum((F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col(f"{s}_n{c}") for c in XYZ)) / (unit[s] * F.col("d")) for s in "ab"]
    return p.filter((F.col("d") > 0) & (dot >= least_dot) & (F.greatest(*chord) <= steep)).select(F.col("a_atom").alias("a"), F.col("b_atom").alias("b"), "d")


def conductance(distance: Column, dot: Column, bend: Column, sd: float = 1.0, sn: float = 0.5, sk: float = 0.5) -> Column:
    return F.exp(-distance * distance / (2 * sd * sd) - (1 - dot) / sn - bend * bend / (2 * sk * sk))


def gaussian_projection(points: DataFrame, atoms: DataFrame, reach: float, feature: str, sigma: float = 2.0, keep: Column | None = None) -> DataFrame:
    """Per point: sum and mean of an atom feature with Gaussian weights, and their ratio to the total weight; 0 where no atom is near, as defined."""
    w = near_pairs(points, atoms, reach, keep).withColumn("w", F.exp(-F.col("d2") / (2 * sigma * sigma)))
    a = w.groupBy(F.col("a_atom").alias("atom")).agg(F.sum(F.col("w") * F.col(f"b_{feature}")).alias("total"), F.sum("w").alias("weight"))
    return points.select("atom").join(a, "atom", "left").select("atom", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(ratio(F.col("total"), F.col("weight")), F.lit(0.0)).alias("mean"))


def spectral_diffusion(modes: DataFrame, values: DataFrame, length: float) -> DataFrame:
    """phi exp(-lambda t) phi^T M x: modes (mode, eigenvalue, point, phi), values (point, mass, x); two joins and sums."""
    projected = modes.join(values, "point").groupBy("mode", "eigenvalue").agg(F.sum(F.col("phi") * F.col("mass") * F.col("x")).alias("c"))
    damped = projected.select("mode", (F.col("c") * F.exp(-F.col("eigenvalue") * length)).alias("c"))
    return modes.join(damped, "mode").groupBy("point").agg(F.sum(F.col("phi") * F.col("c")).alias("x"))


def exposed_area(atoms: DataFrame, directions: DataFrame, probe: float, largest: float, count: int) -> DataFrame:
    """Per atom: the share of the directions (k, x, y, z of a unit sphere, ``count`` rows) at its expanded radius that lie in no other atom's, times 4 pi R^2."""
    d = directions.select("k", *(F.col(c).alias(f"u{c}") for c in XYZ))
    r = F.col("radius") + probe
    spots = atoms.crossJoin(F.broadcast(d)).select("atom", "k", *((F.col(c) + r * F.col(f"u{c}")).alias(c) for c in XYZ))  # count directions for each atom
    inside = (F.col("d") < F.col("b_radius") + probe - 1e-9) & (F.col("a_atom") != F.col("b_atom"))
    there, reach = few_of_place(atoms.select("atom", *XYZ, "radius"), "atom", 2, ["radius"]), largest + probe
    hidden = by_rings(spots, there, ["atom", "k"], first_ring(there, 4, reach), reach, lambda pairs, ring, last: pairs.select(F.col("a_atom").alias("atom"), F.col("a_k").alias("k")).distinct(), inside, "right")
    gone = hidden.groupBy("atom").agg(F.count("*").alias("gone"))
    return atoms.join(gone, "atom", "left").select("atom", ((1 - F.coalesce("gone", F.lit(0)) / count) * 4 * F.lit(np.pi) * r * r).alias("area"))


def view_agreement(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Per group, of two maps normalized to masses: Jensen-Shannon divergence in bits, total variation, Pearson (NULL if constant)."""
    w = Window.partitionBy(*by)
    p, q = F.col(a) / F.sum(a).over(w), F.col(b) / F.sum(b).over(w)
    rows = df.withColumn("p", p).withColumn("q", q).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda x: F.sum(F.when((F.col(x) > 0) & (F.col("m") > 0), F.col(x) * F.log2(F.try_divide(F.col(x), F.col("m")))).otherwise(0.0))
    return rows.groupBy(*by).agg(((kl("p") + kl("q")) / 2).alias("js"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), pearson(a, b).alias("pearson"))


def relation_messages(edges: DataFrame, features: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Per node: over directed edges (src, dst, relation), the mean of the sources' feature for each relation, times its gate, summed."""
    directed = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))
    means = directed.join(features.select(F.col("node").alias("src"), "value"), "src").groupBy("dst", "relation").agg(F.avg("value").alias("m"))
    gate = F.coalesce(*(F.when(F.col("relation") == k, F.lit(v)) for k, v in gates.items()), F.lit(0.0))
    return means.groupBy(F.col("dst").alias("node")).agg(F.sum(gate * F.col("m")).alias("message"))


def grouped_kernel(df: DataFrame, by: str, kernel, schema: str) -> DataFrame:
    """One structure per call: its rows are bounded by the structure's size."""
    return df.groupBy(by).applyInPandas(kernel, schema)


def rigid_fits(pairs: DataFrame, by: str) -> DataFrame:
    """Kabsch: per structure of paired points (x, y, z, u, v, w) the rotation (row-major) from the first to the second, and the rmsd."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[["x", "y", "z"]].to_numpy(), pdf[["u", "v", "w"]].to_numpy()
        p, q = a - a.mean(0), b - b.mean(0)
        s, _, t = np.linalg.svd(p.T @ q)
        r = t.T @ np.diag([1, 1, np.sign(np.linalg.det(t.T @ s.T)) or 1.0]) @ s.T
        return pd.DataFrame({by: [pdf[by].iloc[0]], "rotation": [r.ravel().tolist()], "rmsd": [float(np.sqrt(((p @ r.T - q) ** 2).sum(1).mean()))]})

    return grouped_kernel(pairs, by, fit, f"{by} {pairs.schema[by].dataType.simpleString()}, rotation array<double>, rmsd double")


def surface_normals(points: DataFrame, by: str, k: int = 8) -> DataFrame:
    """Per point (atom): the direction of least spread of it and its k nearest in its structure, turned away from the structure's centre."""
    from bagweave.operators.neighbours import all_neighbours

    rows = points.select(F.struct(by).alias("structure"), "atom", *XYZ)  # a null structure is one too
    place = F.array(*(F.col(c) for c in XYZ))
    near = all_neighbours(rows, "structure", "atom", XYZ, k).join(rows.select(F.col("atom").alias("dst"), place.alias("p")), "dst").select(F.col("src").alias("atom"), "rank", "p")
    sets = near.unionByName(rows.select("atom", F.lit(0).alias("rank"), place.alias("p"))).groupBy("atom").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda r: r["p"])).alias("near"))
    middles = rows.groupBy("structure").agg(F.array(*(F.avg(c) for c in XYZ)).alias("middle"))
    whole = rows.join(F.broadcast(middles), "structure").select("atom", "middle").join(sets, "atom")

    def normals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, own in pdf.groupby(pdf["near"].map(len)):
                x, middle = np.stack(own["near"]).reshape(len(own), size // 3, 3), np.stack(own["middle"])
                spread = x - x.mean(1, keepdims=True)
                n = np.full((len(own), 3), np.nan) if size == 3 else np.linalg.eigh(np.einsum("mki,mkj->mij", spread, spread))[1][:, :, 0]
                n = np.where((((x[:, 0] - middle) * n).sum(1) >= 0)[:, None], n, -n)
                yield pd.DataFrame({"atom": own["atom"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    return whole.mapInPandas(normals, "atom long, nx double, ny double, nz double")


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round() does, by the shortest decimals that give the value."""
    scaled = np.abs(values) * 10**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10**digits, values) + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def dihedrals(atoms: DataFrame, atom: str, radius: float, digits: int) -> DataFrame:
    """Signed dihedral angles, rounded, of all paths i-j-k-l of four different atoms, each within the radius of the next, each path once (i < l): i, j, k, l, torsion.

    Paths are many more than atoms (the fourth power of a dense place), so neither they nor their edges are written or dealt out: a task takes the
    cells of second atoms with all atoms two radii about them, and gives the paths away in slices of PATHS.
    """
    own = [F.floor(F.col(c) / radius).cast("long") for c in XYZ]
    around = neighbour_cells(atoms.select(atom, *XYZ).dropna(), radius, 2).withColumn("_own", F.lit(True))
    for c, o in zip(XYZ, own, strict=True):
        around = around.withColumn("_own", F.col("_own") & (F.col(f"c{c}") == o))
    cells = [f"c{c}" for c in XYZ]
    tasks = FINER * max(1, int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["i", "j", "k", "l", "torsion"]

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, x, y, z = (t.column(c).to_numpy() for c in (atom, *XYZ))
        beside: dict[int, np.ndarray] = {}

        def near(p: int) -> np.ndarray:
            if p not in beside:
                dx, dy, dz = x[p] - x, y[p] - y, z[p] - z
                beside[p] = np.flatnonzero((dx * dx + dy * dy + dz * dz <= radius * radius) & (ids != ids[p]))
            return beside[p]

        def angles(i: np.ndarray, j: int, k: int, l: np.ndarray) -> pa.RecordBatch | None:  # noqa: E741
            at, to = np.nonzero((ids[i][:, None] < ids[l]) & (i[:, None] != l))
            if not len(at):
                return None
            vx, vy, vz = x[k] - x[j], y[k] - y[j], z[k] - z[j]
            ux, uy, uz, wx, wy, wz = x[j] - x[i], y[j] - y[i], z[j] - z[i], x[l] - x[k], y[l] - y[k], z[l] - z[k]
            m = [a[at] for a in (uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx)]
            n = [a[to] for a in (vy * wz - vz * wy, vz * wx - vx * wz, vx * wy - vy * wx)]
            sine = np.sqrt(vx * vx + vy * vy + vz * vz) * (ux[at] * n[0] + uy[at] * n[1] + uz[at] * n[2])
            angle = half_up(np.arctan2(sine, m[0] * n[0] + m[1] * n[1] + m[2] * n[2]), digits)
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (ids[i[at]], np.full(len(at), ids[j]), np.full(len(at), ids[k]), ids[l[to]], angle)], names)

        held, size = [], 0
        for j in np.flatnonzero(t.column("_own").to_numpy()):
            for k in near(j):
                first, last = near(j), near(k)
                first, last = first[first != k], last[last != j]
                step = max(1, PATHS // max(1, len(last)))
                for s in range(0, len(first), step):
                    if (found := angles(first[s : s + step], j, k, last)) is not None:
                        held.append(found)
                        size += found.num_rows
                    if size >= PATHS:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    kind = atoms.schema[atom].dataType.simpleString()
    dealt = around.select(*cells, atom, *XYZ, "_own").repartition(tasks, *cells)
    return dealt.groupBy(*cells).applyInArrow(paths, f"i {kind}, j {kind}, k {kind}, l {kind}, torsion double")


def outside_cells(cells: DataFrame, by: str) -> DataFrame:
    """Grid cells (cx, cy, cz, filled) of each structure: outer if free and reached from the border through faces, else filled or enclosed."""

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[["cx", "cy", "cz"]].to_numpy()
        at = c - c.min(0)
        free = np.zeros(at.max(0) + 3, bool)
        free[:] = True
        free[tuple((at + 1).T)] = ~pdf["filled"].to_numpy(bool)
        seen = np.zeros_like(free)
        seen[0], seen[-1], seen[:, 0], seen[:, -1], seen[:, :, 0], seen[:, :, -1] = (True,) * 6
        while True:
            grown = seen.copy()
            for axis in range(3):
                grown |= np.roll(seen, 1, axis) | np.roll(seen, -1, axis)
            grown &= free
            grown |= seen
            if (grown == seen).all():
                break
            seen = grown
        state = np.where(pdf["filled"], "filled", np.where(seen[tuple((at + 1).T)], "outer", "enclosed"))
        return pd.DataFrame({by: pdf[by], "cx": pdf["cx"], "cy": pdf["cy"], "cz": pdf["cz"], "state": state})

    return grouped_kernel(cells, by, flood, f"{by} {cells.schema[by].dataType.simpleString()}, cx long, cy long, cz long, state string")


def similar_directions(vectors: DataFrame, identifier: str, values: str, threshold: float) -> DataFrame:
    """src < dst: pairs whose cosine is ``threshold`` (above 0) or more, or minus that or less.

    Rows fall into blocks by hash, and each pair of blocks is one group whose cosines are matrix products. In many dimensions cells would spare
    little, so the work is that of all pairs; a task holds two blocks, and a row goes to as many groups as there are blocks.
    """
    unit = F.transform(values, lambda x: x.cast("double"))
    rows = vectors.select(F.col(identifier).alias("id"), unit.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = cut(rows.filter("v is not null").withColumn("length", length).select("id", F.transform("v", lambda x: x / F.greatest(F.col("length"), F.lit(1e-12))).alias("v")))
    blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    group = F.least("own", "other") * blocks + F.greatest("own", "other")
    kind = vectors.schema[identifier].dataType.simpleString()

    def alike(t: pa.Table) -> pa.Table:
        ids, own, other = t.column("id").combine_chunks(), t.column("own").to_numpy(), t.column("other").to_numpy()
        if own.min() == own.max() and own[0] != other[0]:  # the other block is empty, and this one has a group of its own
            return pa.table({"a": ids.slice(0, 0), "b": ids.slice(0, 0)})
        if pc.count_distinct(pc.list_value_length(t.column("v"))).as_py() > 1:
            raise ValueError("directions differ in their number of axes")
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        first = np.flatnonzero(own == own.min())
        second = np.flatnonzero(own == own.max())
        found = [np.empty((2, 0), np.int64)]
        step = max(1, SLICE // max(1, len(second)))
        for s in range(0, len(first), step):
            part = first[s : s + step]
            i, j = np.nonzero(np.abs(v[part] @ v[second].T) >= threshold - 1e-9)
            found.append(np.stack([part[i], second[j]]))
        i, j = np.concatenate(found, 1)
        i, j = (x[(i < j) | (own[i] != own[j])] for x in (i, j))  # within a block each pair once
        cosine = np.zeros(len(i))
        for k in range(v.shape[1]):  # in the order of the axes, as a plain sum
            cosine += v[i, k] * v[j, k]
        kept = np.abs(cosine) >= threshold
        return pa.table({"a": ids.take(pa.array(i[kept])), "b": ids.take(pa.array(j[kept]))})

    pairs = placed.withColumn("group", group).groupBy("group").applyInArrow(alike, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def independent_directions(vectors: DataFrame, identifier: str, values: str, score: str, threshold: float) -> DataFrame:
    """identifier and score of what a greedy pass by falling score (ties: the lesser id) keeps: ids whose absolute cosine with every id kept before is under the threshold.

    The pass is the lexicographically first independent set of the pairs that are too alike: in each round an id is kept if no undecided id with
    such a pair goes before it, and those alike go. Rounds are as many as the longest chain of falling scores along pairs.
    """
    pairs = cut(similar_directions(vectors, identifier, values, threshold))
    rank = vectors.select(F.col(identifier).alias("id"), F.struct((-F.col(score)).alias("s"), F.col(identifier).alias("i")).alias("rank"))
    both = pairs.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src").join(rank.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst")
    first = F.col("a") < F.col("b")
    open_ = cut(both.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("before"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("after")))
    gone = None
    while not open_.isEmpty():
        waits = open_.select(F.col("after").alias("before")).distinct()
        kept = open_.select("before").distinct().join(waits, "before", "left_anti")
        new = cut(open_.join(kept, "before", "left_semi").select(F.col("after").alias("id")).distinct())
        gone = new if gone is None else gone.unionAll(new)
        open_ = cut(open_.join(kept, "before", "left_anti").join(new.withColumnRenamed("id", "before"), "before", "left_anti").join(new.withColumnRenamed("id", "after"), "after", "left_anti"))
    own = vectors.select(identifier, score)
    return own if gone is None else own.join(gone.withColumnRenamed("id", identifier), identifier, "left_anti")

