"""Seeded choice of populations, leakage-safe splits and nested subsets.

The greedy loops run on aggregated group tables (one row for each group of records that stay together, or for each
distinct stratum with its count), not on the records; what they decide is joined back or ranked in Spark.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bagweave.functions.scalar import seeded_rank

#: Rows of a group table that one task takes; more are an error, not a sample.
MAX_GROUPS = 2_000_000


def rank_key(seed: int | str, value: object) -> str:
    return hashlib.sha256(f"{seed}:{value}".encode()).hexdigest()


def group_table(rows: DataFrame, group: str, strata: Sequence[str]) -> DataFrame:
    """One row for each group: size and, for each stratum column, a map of value to count."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    for s in strata:
        counts = rows.groupBy(group, F.coalesce(F.col(s).cast("string"), F.lit("unavailable")).alias("_v")).agg(F.count("*").alias("_n"))
        maps = counts.groupBy(F.col(group).alias("_g")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(s))
        sizes = sizes.join(maps, F.col(group) == F.col("_g")).drop("_g")
    return sizes


def sequential(table: DataFrame, decide, schema: str) -> DataFrame:
    """Runs a sequential decision over a bounded group table in one task."""
    n = table.count()
    if n > MAX_GROUPS:
        raise ValueError(f"{n} groups; a sequential decision takes {MAX_GROUPS} at most")
    return table.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda pdf: decide(pdf.drop(columns="_one")), schema)


def assign_splits(rows: DataFrame, group: str, fractions: Mapping[str, float], weights: Mapping[str, float], seed: int = 2026, forced: Mapping[str, str] | None = None) -> DataFrame:
    """(group, split): whole groups, largest first, each to the split whose normalized squared deviations grow least.

    weights: stratum column to weight (size weighs 2); every value of every stratum takes part in the cost. Forced groups go
    first to their split. Ties in size fall to the seeded rank of the group, ties in cost to that of group and split.
    """
    strata, forced, names = list(weights), dict(forced or {}), list(fractions)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Counter()
        for s in strata:
            for counts in pdf[s]:
                for v, n in counts:
                    total[s, v] += n
        everything = float(pdf["size_"].sum())
        held = {p: 0.0 for p in names}
        seen = {p: Counter() for p in names}
        order = sorted(pdf.itertuples(index=False), key=lambda r: (getattr(r, group) not in forced, -r.size_, rank_key(seed, getattr(r, group))))
        out = []
        for r in order:
            g = getattr(r, group)
            own = {(s, v): n for s in strata for v, n in getattr(r, s)}

            def cost(p: str) -> float:
                f = fractions[p]
                dev = lambda have, want: ((have - want) / max(want, 1.0)) ** 2
                c = 2 * (dev(held[p] + r.size_, everything * f) - dev(held[p], everything * f))
                for k, n in own.items():  # values the group lacks change nothing
                    c += weights[k[0]] * (dev(seen[p][k] + n, total[k] * f) - dev(seen[p][k], total[k] * f))
                return c

            p = forced.get(g) or min(names, key=lambda p: (cost(p), rank_key(seed, f"{g}:{p}")))
            held[p] += r.size_
            for k, n in own.items():
                seen[p][k] += n
            out.append((g, p))
        return pd.DataFrame(out, columns=[group, "split"])

    table = group_table(rows, group, strata).withColumnRenamed("size", "size_")
    flat = table.select(group, "size_", *(F.map_entries(s).alias(s) for s in strata))
    return sequential(flat, lambda pdf: decide(pdf.assign(**{s: [[(e["key"], e["value"]) if isinstance(e, dict) else (e[0], e[1]) for e in x] for x in pdf[s]] for s in strata})), f"{group} {rows.schema[group].dataType.simpleString()}, split string")


def nested_subsets(rows: DataFrame, group: str, strata: Sequence[str], fractions: Sequence[float], seed: int = 2026, replicate: int = 0) -> DataFrame:
    """(group, place, cumulative, view_NN...): whole groups in a greedy order, each fraction the shortest prefix with half-even round(n * fraction) rows.

    The next group is that with the least sums over its rows of the counts so far of the rows' strata, then by seeded rank. Prefixes nest.
    """

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, Counter] = defaultdict(Counter)
        left = {getattr(r, group): r for r in pdf.itertuples(index=False)}
        ranks = {g: rank_key(f"{seed}{replicate}", g) for g in left}
        cost = lambda g: (tuple(sum(n * seen[s][v] for v, n in getattr(left[g], s)) for s in strata), ranks[g])
        heap = [(cost(g), g) for g in left]  # costs only grow, so an entry that is still true when it comes up is the least
        heapq.heapify(heap)
        out = []
        while heap:
            told, g = heapq.heappop(heap)
            if (now := cost(g)) != told:
                heapq.heappush(heap, (now, g))
                continue
            r = left[g]
            for s in strata:
                for v, n in getattr(r, s):
                    seen[s][v] += n
            out.append((g, len(out) + 1, int(r.size_)))
        return pd.DataFrame(out, columns=[group, "place", "size"])

    table = group_table(rows, group, strata).withColumnRenamed("size", "size_")
    flat = table.select(group, "size_", *(F.map_entries(s).alias(s) for s in strata))
    placed = sequential(flat, lambda pdf: decide(pdf.assign(**{s: [[(e["key"], e["value"]) if isinstance(e, dict) else (e[0], e[1]) for e in x] for x in pdf[s]] for s in strata})), f"{group} {rows.schema[group].dataType.simpleString()}, place int, size long")
    w = Window.orderBy("place")  # one row for each group
    running = placed.withColumn("cumulative", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = running.agg(F.sum("size").alias("total"))
    out = running.crossJoin(F.broadcast(total))
    views = {f"view_{round(f * 100):02d}": (F.col("cumulative") - F.col("size") < F.bround(F.col("total") * f, 0)) for f in fractions}
    return out.select(group, "place", "cumulative", *(c.alias(n) for n, c in views.items()))


def diverse_choice(rows: DataFrame, identifier: str, group: str, strata: Sequence[str], target: int, seed: int = 2026, preferred: str | None = None) -> DataFrame:
    """The identifiers of ``target`` rows, picked one by one by the least (not preferred, count of its group, counts of its strata, seeded rank).

    Rows of one group and strata differ only by rank, so the loop runs over (group, strata) cells with the ranks of their first ``target`` rows,
    eight bytes each, in a heap whose stale entries are put back; it decides how many rows each cell gives, and Spark takes those of the least rank.
    """
    cells = rows.withColumn("_pref", F.lit(0) if preferred is None else F.when(F.col(preferred), 0).otherwise(1))
    cells = cells.select(F.col(identifier).alias("_id"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"), *(F.coalesce(F.col(s).cast("string"), F.lit("")).alias(f"_s{i}") for i, s in enumerate(strata)), "_pref", seeded_rank(seed, F.col(identifier)).alias("_rank"))
    keys = ["_pref", "_g", *(f"_s{i}" for i in range(len(strata)))]
    ranked = cells.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "_id"))).filter(F.col("_r") <= target)
    counted = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.conv(F.substring("_rank", 1, 15), 16, 10).cast("long"))).alias("_ranks"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.to_dict("records")
        seen, taken = Counter(), Counter()
        key = lambda i: (records[i]["_pref"], *(seen[k, records[i][k]] for k in keys[1:]), records[i]["_ranks"][taken[i]])
        heap = [(key(i), i) for i in range(len(records))]
        heapq.heapify(heap)
        picked = 0
        while heap and picked < target:
            old, i = heapq.heappop(heap)
            if (now := key(i)) != old:
                heapq.heappush(heap, (now, i))
                continue
            picked += 1
            taken[i] += 1
            for k in keys[1:]:
                seen[k, records[i][k]] += 1
            if taken[i] < len(records[i]["_ranks"]):
                heapq.heappush(heap, (key(i), i))
        return pd.DataFrame([{**{k: records[i][k] for k in keys}, "_take": n} for i, n in taken.items()], columns=[*keys, "_take"])

    takes = sequential(counted, decide, ", ".join("_pref int" if k == "_pref" else f"{k} string" for k in keys) + ", _take long")
    return ranked.join(takes, keys).filter("_r <= _take").select(F.col("_id").alias(identifier))


def quota_population(rows: DataFrame, identifier: str, label: str, group: str, strata: Sequence[str], ratio: float, seed: int = 2026) -> DataFrame:
    """All negatives and half-even round(negatives * ratio) diverse positives; an error if there are too few."""
    counts = rows.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    target = round(counts["n"] * ratio)
    if target > counts["p"]:
        raise ValueError(f"{target} positives are wanted; there are {counts['p']}")
    chosen = diverse_choice(rows.filter(F.col(label) == 1), identifier, group, strata, target, seed)
    return rows.filter(F.col(label) == 0).select(identifier).unionAll(chosen)


def stratified_sample(rows: DataFrame, identifier: str, stratum: str, shares: Mapping[str, float], total: int, seed: int = 7) -> DataFrame:
    """At most ``total`` rows by hash order within strata: each stratum its share, what some can't fill going to the others in hash order."""
    share = F.coalesce(*(F.when(F.col(stratum) == k, F.lit(int(total * f))) for k, f in shares.items()), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_rank(seed, F.col(identifier)), identifier))
    r = rows.withColumn("_own", rank <= share)
    return r.orderBy(F.col("_own").desc(), seeded_rank(seed, F.col(identifier)), identifier).limit(total).select(identifier)
