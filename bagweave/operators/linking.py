"""Links between records: thresholded pairs, exact-key stars, groups that must stay together, duplicates and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.ranged import ranged_places
from bagweave.functions.scalar import fraction
from bagweave.operators.graph import connected_components


def canonical(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("src"), F.greatest(left, right).alias("dst")]


def sequence_edges(pairs: DataFrame, identity: float = 0.3, coverage: float = 0.8, evalue: float = 1e-3) -> DataFrame:
    """Distinct canonical (src, dst) of pairs with enough identity and bilateral coverage; scores may be per cent; self pairs go."""
    ok = (fraction(F.col("fident")) >= identity) & (F.least(fraction(F.col("qcov")), fraction(F.col("tcov"))) >= coverage) & (F.col("evalue") <= evalue) & (F.col("query") != F.col("target"))
    return pairs.filter(ok).select(*canonical("query", "target")).distinct()


def structure_edges(pairs: DataFrame, probability: float = 0.9, tm: float = 0.75, coverage: float = 0.8, evalue: float = 1e-3) -> DataFrame:
    """The same by probability, both TM scores and both coverages; ids are file stems."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    ok = (fraction(F.col("prob")) >= probability) & (F.least("qtmscore", "ttmscore") >= tm) & (F.least(fraction(F.col("qcov")), fraction(F.col("tcov"))) >= coverage) & (F.col("evalue") <= evalue)
    return pairs.filter(ok).select(stem("query").alias("q"), stem("target").alias("t")).filter("q != t").select(*canonical("q", "t")).distinct()


def star_edges(rows: DataFrame, identifier: str, keys: dict[str, str]) -> DataFrame:
    """For each key column, the least id of a key linked with each other id that has it: src, dst, reasons (sorted, of all keys).

    The least id is a partial aggregate joined back, so a key that many rows share is not gathered.
    """
    out = None
    for reason, key in keys.items():
        own = rows.filter(F.col(key).isNotNull()).select(F.col(identifier).alias("dst"), F.col(key).alias("k"))
        star = own.join(own.groupBy("k").agg(F.min("dst").alias("src")), "k").filter("src != dst").select("src", "dst", F.lit(reason).alias("reason"))
        out = star if out is None else out.unionAll(star)
    return out.groupBy("src", "dst").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def leakage_groups(rows: DataFrame, identifier: str, edges: Sequence[DataFrame]) -> DataFrame:
    """Adds leakage_group (least id reachable over all edges) and group_name, L and a number of five digits or more in order of the least ids, to every row."""
    union = None
    for e in edges:
        union = e.select("src", "dst") if union is None else union.unionAll(e.select("src", "dst"))
    comp = connected_components(union).withColumnRenamed("id", "vertex")
    out = rows.join(comp, F.col(identifier) == F.col("vertex"), "left").withColumn("leakage_group", F.coalesce("component", F.col(identifier))).drop("vertex", "component")
    names = ranged_places(out.select("leakage_group").distinct(), [F.col("leakage_group")], "nth").select("leakage_group", F.format_string("L%05d", "nth").alias("group_name"))
    return out.join(names, "leakage_group")


def unknown_ends(edges: DataFrame, rows: DataFrame, identifier: str) -> DataFrame:
    """Edges with an end that no row has; the guard before grouping."""
    ids = rows.select(F.col(identifier).alias("id"))
    return edges.join(ids, F.col("src") == F.col("id"), "left_anti").unionByName(edges.join(ids, F.col("dst") == F.col("id"), "left_anti")).distinct()


def deduplicated(rows: DataFrame, identifier: str, key: str, label: str) -> DataFrame:
    """One row per key: least id, number of rows, conflict (labels disagree) and the label if they don't."""
    return rows.groupBy(key).agg(F.min(identifier).alias("kept"), F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("conflict"), F.when(F.min(label) == F.max(label), F.min(label)).alias("label"))


def merged_sources(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Full outer join of two sources by key: both / left / right, conflict where labels disagree."""
    r = b.select(F.col(key).alias("k2"), F.col(label).alias("l2"))
    j = a.select(F.col(key).alias("k1"), F.col(label).alias("l1")).join(r, F.col("k1") == F.col("k2"), "full")
    side = F.when(F.col("k1").isNull(), "right").when(F.col("k2").isNull(), "left").when(F.col("l1") != F.col("l2"), "conflict").otherwise("both")
    return j.select(F.coalesce("k1", "k2").alias(key), side.alias("origin"), F.when(side != "conflict", F.coalesce("l1", "l2")).alias(label))


def cross_split_pairs(edges: DataFrame, members: DataFrame, identifier: str, split: str) -> DataFrame:
    """Edges whose ends are both known and lie in different splits."""
    left = members.select(F.col(identifier).alias("src"), F.col(split).alias("split_src"))
    right = members.select(F.col(identifier).alias("dst"), F.col(split).alias("split_dst"))
    return edges.join(left, "src").join(right, "dst").filter("split_src != split_dst")


def balanced_view(rows: DataFrame, identifier: str, label: str, salt: str) -> DataFrame:
    """As many rows of each label as the rarest has, by salted hash."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    w = Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(salt), F.col(identifier).cast("string")), 256), identifier)
    return rows.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(least)).filter("r <= least").drop("r", "least")


def annotated(rows: DataFrame, notes: DataFrame, identifier: str, digest: str) -> DataFrame:
    """Left join of frozen notes (identifier, digest, note): kept only where the digest is equal; missing stays missing."""
    n = notes.select(F.col(identifier).alias("nid"), F.col(digest).alias("nd"), "note")
    return rows.join(n, (F.col(identifier) == F.col("nid")) & (F.col(digest) == F.col("nd")), "left").drop("nid", "nd")


def region_lineage(before: DataFrame, after: DataFrame, link: float = 0.5) -> DataFrame:
    """Regions (region, point, mass, anchor) of two snapshots: overlap over the smaller mass at least link and the anchor inside make a link;
    one to one is same, one to several split, several to one merge, none lost. Returns region, fate of the earlier regions."""
    a = before.select(F.col("region").alias("ra"), F.col("point").alias("pa"), F.col("mass").alias("ma"), F.col("anchor").alias("anchor"))
    b = after.select(F.col("region").alias("rb"), F.col("point").alias("pb"), F.col("mass").alias("mb"))
    ta, tb = a.groupBy("ra").agg(F.sum("ma").alias("ta")), b.groupBy("rb").agg(F.sum("mb").alias("tb"))
    both = a.join(b, F.col("pa") == F.col("pb")).groupBy("ra", "rb").agg(F.sum(F.least("ma", "mb")).alias("o"), F.max((F.col("pa") == F.col("anchor")).cast("int")).alias("inside"))
    links = both.join(ta, "ra").join(tb, "rb").filter((F.col("o") >= link * F.least("ta", "tb")) & (F.col("inside") == 1))
    degree = links.withColumn("out", F.count("*").over(Window.partitionBy("ra"))).withColumn("into", F.count("*").over(Window.partitionBy("rb")))
    fate = degree.groupBy("ra").agg(F.max("out").alias("out"), F.max("into").alias("into"))
    return ta.join(fate, "ra", "left").select(F.col("ra").alias("region"), F.when(F.col("out").isNull(), "lost").when(F.col("out") > 1, "split").when(F.col("into") > 1, "merge").otherwise("same").alias("fate"))
