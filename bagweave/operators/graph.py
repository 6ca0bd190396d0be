"""Connected components by alternating star contraction, and depths by bits of many sources at once, both checkpointed each round; depths among near points within tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.functions.lineage import cut
from bagweave.functions.ranged import dealt, ranged_places
from bagweave.operators.spatial import XYZ

#: Longs of a row's bits, and shares in which a block's rows are given away.
WORDS, SHARES = 16, 32
#: Edges that a task takes; no more make a round of one task, without a shuffle, however many partitions the session has.
EDGES_PER_TASK = 20_000
#: Sources of a task's group of near_depths(), distances of a block, and rows that a batch has at least.
SOURCES, DISTANCES, BATCH = 2048, 262_144, 131_072
#: Tasks of near_depths() for each of the session's partitions, as few rows make much work there.
FINER = 8


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of an edge, component being the least id reachable.

    Large-star: each vertex sends its larger neighbours to the least of its neighbourhood; small-star: its smaller
    ones and itself. Minima are partial aggregates joined back to the edges, so a hub's edges are never gathered. The
    number of rounds is logarithmic in the longest path. Self loops, repeated edges and null ends are allowed; the last are dropped.
    A round has as many tasks as the edges left ask for: few edges dealt over all partitions would be files of some bytes each.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = e.filter("u = v").select("u").distinct()
    e = e.filter("u != v").distinct().transform(cut)
    n, before = e.count(), None
    while True:
        tasks = max(1, -(-n // EDGES_PER_TASK))
        e, near = e.coalesce(tasks), F.broadcast if tasks == 1 else lambda small: small
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near(least), "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(lower), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v")))
        e = small.coalesce(tasks).distinct().transform(cut)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        n, before = now[0], now
    e = e.coalesce(tasks)
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    stars = e.unionAll(roots)
    alone = loops.join(stars, "u", "left_anti").select("u", F.col("u").alias("v"))
    return stars.unionAll(alone).select(F.col("u").alias("id"), F.col("v").alias("component"))


def bounded_depths(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """(src, dst, depth): the least number of edges from each source, up to the limit. Edges (src, dst) stand from both ends.

    Sources go in blocks of 64 * WORDS; a row holds a vertex and a block with a bit for each source, so an edge moves a whole block at once. A
    neighbour is at most one step nearer or farther, so what a step finds anew is what the last two don't hold. The sources' first column is their id,
    further ones order them: blocks of sources that lie together are found together.
    """
    key, *order = sources.columns
    words = [f"w{i}" for i in range(WORDS)]
    every = ranged_places(sources.filter(F.col(key).isNotNull()), [*map(F.col, order), F.col(key)], "_place")
    placed = cut(every.select(F.col(key).alias("dst"), F.floor((F.col("_place") - 1) / (64 * WORDS)).alias("block"), ((F.col("_place") - 1) % (64 * WORDS)).cast("int").alias("at")))
    none = F.lit(0).cast("long")
    step = cut(dealt(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), ["dst"]))
    bit = F.expr("shiftleft(1L, at % 64)")
    frontier = cut(placed.select("dst", "block", *(F.when(F.floor(F.col("at") / 64) == i, bit).otherwise(none).alias(w) for i, w in enumerate(words))))
    before, found = frontier.limit(0), frontier.withColumn("depth", F.lit(0))
    for depth in range(1, limit + 1):
        hits = dealt(frontier, ["dst"]).join(step, "dst").select(F.col("next").alias("dst"), "block", *words, F.lit(False).alias("old"))
        for old in (frontier, before):  # a mark, as zeros for each word would make the optimizer's constraints grow with their powers
            hits = hits.unionAll(old.select("dst", "block", *words, F.lit(True).alias("old")))
        bits = {w: (F.bit_or(F.when(~F.col("old"), F.col(w))), F.bit_or(F.when(F.col("old"), F.col(w)))) for w in words}
        each = hits.groupBy("dst", "block").agg(*(F.coalesce(new.bitwiseAND(F.bitwise_not(F.coalesce(known, none))), none).alias(w) for w, (new, known) in bits.items()))
        before, frontier = frontier, cut(each.filter(f"{' | '.join(words)} <> 0"))
        if frontier.isEmpty():
            break
        found = found.unionAll(frontier.withColumn("depth", F.lit(depth)))
    # each block's ids once for each share of its rows, so that no block is one task
    ids = placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dst"))), lambda r: r["dst"]).alias("ids"))
    shares = dealt(ids.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["block", "share"])
    rows = dealt(found.withColumn("share", F.pmod(F.xxhash64("dst"), F.lit(SHARES)).cast("int")), ["block", "share"]).join(shares, ["block", "share"])
    set_in = lambda w: lambda _, at: F.getbit(w, at) == 1
    own = [F.when(F.col(w) == 0, F.slice("ids", 1, 0)).otherwise(F.filter(F.slice("ids", 64 * i + 1, 64), set_in(w))) for i, w in enumerate(words)]
    return rows.select(F.explode(F.flatten(F.array(*own))).alias("src"), "dst", "depth")


def near_depths(points: DataFrame, key: str, radius: float, limit: int) -> DataFrame:
    """(src, dst, depth): the least number of steps of at most the radius from each point to each other one, up to the limit. The key tells points apart.

    As bounded_depths(), but neither edges nor bits are written or dealt out: both grow with the square of a dense place. A task takes SOURCES points that lie
    together and all points that so many steps can reach, keeps some bits for each, and finds the edges anew in each step.
    """
    cells = [f"c{c}" for c in XYZ]
    known = points.filter(F.col(key).isNotNull()).select(key, *XYZ)
    finite = F.lit(True)
    for c in XYZ:
        finite = finite & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    rows = known.filter(finite).withColumns({f"c{c}": F.floor(F.col(c) / (limit * radius)).cast("long") for c in XYZ})
    together = [*map(F.col, cells), *(F.floor(F.col(c) / (2 * radius)) for c in XYZ), F.col(key)]
    placed = cut(ranged_places(rows, together, "_place").select(key, *XYZ, *cells, F.floor((F.col("_place") - 1) / SOURCES).alias("_home")))
    asked = placed.select(F.col("_home").alias("block"), *cells).distinct()
    for c in cells:
        asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    asked = asked.distinct().join(F.broadcast(placed.select(*cells).distinct()), cells)
    about = placed.join(F.broadcast(asked), cells).select("block", key, *(F.col(c).cast("double").alias(c) for c in XYZ), (F.col("block") == F.col("_home")).alias("_own"))
    kind = points.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, x = t.column(key).to_numpy(), np.stack([t.column(c).to_numpy() for c in XYZ], 1)
        sources = np.flatnonzero(t.column("_own").to_numpy())
        fine = np.floor(x[sources] / (radius / 2)).astype(np.int64)
        # along a curve that fills space: a word's 64 sources are near each other, and in few steps reach a place together
        sources = sources[np.argsort(sum(((fine >> b) & 1) @ np.array([1, 2, 4]) << 3 * b for b in range(20)), kind="stable")]
        held, size = [], 0
        for depth, bits in steps_from(x, sources, radius, limit):
            rows, width = np.flatnonzero(bits.any(1)), 64 * bits.shape[1]
            for part in (rows[s : s + DISTANCES * 8 // width] for s in range(0, len(rows), DISTANCES * 8 // width)):
                at = np.flatnonzero(np.unpackbits(bits[part].view(np.uint8), bitorder="little"))
                dst = at // width
                held.append(pa.RecordBatch.from_arrays([pa.array(ids[sources[at - dst * width]]), pa.array(ids[part[dst]]), pa.array(np.full(len(at), depth, np.int32))], ["src", "dst", "depth"]))
                size += len(at)
                if size >= BATCH:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    tasks = FINER * max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    far = about.repartition(tasks, "block").groupBy("block").applyInArrow(walk, f"src {kind}, dst {kind}, depth int")
    return far.unionAll(known.filter(~finite).select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(0).alias("depth")))


def steps_from(x: np.ndarray, sources: np.ndarray, radius: float, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each depth the bits, by points, of the sources that have just reached them. A point reads those about it that were reached last."""
    edge = radius * (1 + 1e-9)
    cell = np.floor(x / edge)
    order = np.lexsort(cell.T)
    x, cell = x[order], cell[order]
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1)))
    spans = {tuple(cell[a]): (a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True)}
    beside = [(own, [spans[c] for d in product((-1, 0, 1), repeat=3) if (c := (i + d[0], j + d[1], k + d[2])) in spans]) for (i, j, k), own in spans.items()]
    number = np.arange(len(sources))
    new = np.zeros((len(x), -(-len(sources) // 64)), np.uint64)
    new[place[sources], number // 64] = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64))
    every, seen = np.bitwise_or.reduce(new, 0), new.copy()
    yield 0, new[place]
    for depth in range(1, limit + 1):
        last, live, lacking = new, new.any(1), (seen != every).any(1)
        new = np.zeros_like(last)
        for (a, b), spread in beside:
            p = a + np.flatnonzero(lacking[a:b])
            q = np.concatenate([c + np.flatnonzero(live[c:d]) for c, d in spread]) if len(p) else p
            if not len(q):
                continue
            # only sources that some of q hold and some of p lack, and the points that have to do with them
            bits, wanted = last[q], every & ~seen[p]
            both = np.bitwise_or.reduce(bits, 0) & np.bitwise_or.reduce(wanted, 0)
            words = np.flatnonzero(both)
            p, held = p[(wanted & both).any(1)], (bits & both).any(1)
            q, bits = q[held], bits[np.ix_(held, words)]
            step = max(1, DISTANCES // max(1, len(q)))
            for some in (p[s : s + step] for s in range(0, len(p), step)):
                for v, row in zip(some.tolist(), within(x[some], x[q], radius), strict=True):
                    if len(to := np.flatnonzero(row)):
                        new[v, words] = np.bitwise_or.reduce(bits.take(to, 0), 0)
        new &= ~seen
        if not new.any():
            return
        seen |= new
        yield depth, new[place]


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether points are within the radius of each other, by one product; what is too near to the border for its rounding is tested by itself."""
    own, there = a - b[0], b - b[0]
    one, two = np.ones((len(a), 1)), np.ones((len(b), 1))
    d2 = np.hstack([-2 * own, (own * own).sum(1, keepdims=True), one]) @ np.hstack([there, two, (there * there).sum(1, keepdims=True)]).T
    near = d2 <= radius * radius + 1e-9 * (1 + radius * radius)
    i, j = np.nonzero(near & (d2 > radius * radius - 1e-9 * (1 + radius * radius)))
    if len(i):
        dx, dy, dz = (a[i] - b[j]).T
        near[i, j] = dx * dx + dy * dy + dz * dz <= radius * radius
    return near
