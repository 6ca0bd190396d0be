"""N-gram Jaccard join with a count-vector R-tree.

Documents with equal shingle sets form a class (named by a 128-bit digest) and are joined once.

1.  Every chunk of a task's classes sends its distinct tokens (56-bit shingle hashes) to the tokens' ranges, with the place of the
    owner in the chunk; a token that several classes of the chunk own goes once with their number, so a very common token
    costs a chunk one entry. A range answers with the frequency of each token that is not alone, and the chunk writes for each of
    its classes the list of those tokens in one global order, rare ones first, unless it is too short for any link. What two classes share is in
    both lists, so nothing else of the texts is needed from here on.
2.  Linked sets share a token within the first of each in that order, and what follows it in both must be enough for a
    link (prefix and position filter; exact). A token with the classes that may be linked there is a bucket; tokens of the same classes
    share one.
3.  The list's tokens are hashed into groups; the counts of the groups are the class's point. Every bucket gets an R-tree: its points in
    Morton order are packed into leaves, LEAF by LEAF, and nodes into nodes, FANOUT by FANOUT, up to one root, with boxes of maxima. Buckets are
    dealt by ranges of (token, Morton code), so a large one takes many tasks. The summed coordinate minima of two points, or boxes,
    bound the overlap from above.
4.  First the tree is used upward: a point is compared with the centre of its leaf, a node's centre with its parent's. That
    takes one pair for each point or node and joins almost all of a family of near copies.
5.  Then the trees of the buckets that still hold several components are joined with themselves from the roots down. Pairs of nodes whose bound,
    sizes or positions rule a link out, or that lie in one component, are left with all below them; pairs of points that survive are compared.
6.  Surviving pairs are verified on their lists: 100 * shared >= percent * (both - shared).

No limit drops a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from bagweave.llm.common import cut, free_names, partitions, pieces, shingle_sets
from bagweave.operators.graph import connected_components

#: Bits of a token; two of one pair of texts of 1,000 shingles are mistaken for each other with a chance of 1e-11.
TOKEN_BITS, TOKEN_BYTES = 56, 7
#: Tokens that a chunk gathers before it sends them, and that a range receives on average. A longer text is a chunk of its own.
CHUNK, RANGE = 1 << 20, 1 << 20
#: Classes of a chunk (their places are 16-bit), and the place that stands for several owners.
MOST, SEVERAL = 60_000, 65_535
#: Groups of the smallest and largest points (as bits), and the mean count beyond which a point has four times as many.
GROUP_BITS, MOST_BITS, MEAN = 4, 6, 4
#: Members of a leaf and of an inner node.
LEAF, FANOUT = 32, 16
#: A count that is no upper bound any more.
FULL, UNBOUNDED = 65_535, 1 << 32
#: Pairs with one class that are verified together.
PAIRS_PER_TASK = 64
#: Pairs that are few enough to broadcast (16 bytes each).
FEW = 10_000


def least_overlap(n: Column | np.ndarray | int, percent: int):
    """ceil(percent / 100 * n): a linked set shares so many shingles at least."""
    return -(-n * percent // 100)


def batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, id (digest of the set), n (its size)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches):
            sets, _ = shingle_sets(raw, at)
            yield batch("doc_id id n", rows.column(0), pa.array(map(set_id, sets), pa.binary()), pa.array(map(len, sets), pa.int64()))

    return docs.select("doc_id", "text").mapInArrow(profile, "doc_id long, id binary, n long")


def set_id(s: np.ndarray) -> bytes:
    return xxh3_128_digest(s.tobytes())


# --- lists of shared tokens ------------------------------------------------------------------


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, all first bytes, all second ones and so on, compressed."""
    data = values.view(np.uint8).reshape(-1, values.itemsize).T[:width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def from_planes(data: bytes, width: int, kind: type) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = rows.T
    return out.reshape(-1).view(kind)


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens as differences."""
    return planes(np.diff(tokens, prepend=np.uint64(0)), TOKEN_BYTES)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, TOKEN_BYTES, np.uint64), dtype=np.uint64)


#: A blob of a range (own = 0): tokens, owners, counts of those with several owners, or in the answer the frequencies of all. A
#: chunk's own row: digests of its classes, their sizes, owners of the tokens that have several, how many.
ROW = "part int, chunk long, own int, a binary, b binary, c binary, d binary"
ROW_NAMES = "part chunk own a b c d"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return batch(ROW_NAMES, *(pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)))


def sent(docs: DataFrame, ranges: int) -> DataFrame:
    """The chunks' blobs for each range, and their own rows."""

    def chunk_rows(ids: list[bytes], sets: list[np.ndarray], name: str) -> list[tuple]:
        digests = b"".join(ids)
        chunk = int(np.uint64(xxh3_64_intdigest(name.encode() + digests)).astype(np.int64))
        tokens = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(starts, append=len(tokens))
        held = owners[np.repeat(count > 1, count)]
        tokens, owners = tokens[starts], np.where(count > 1, np.uint16(SEVERAL), owners[starts])
        part = ((tokens >> np.uint64(TOKEN_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = owners[i:j]
            out.append((int(part[i]), chunk, 0, packed(tokens[i:j]), planes(own, 2), count[i:j][own == SEVERAL].astype(np.uint32).tobytes(), None))
        sizes = np.array([len(s) for s in sets], np.int64)
        out.append((chunk % ranges, chunk, 1, digests, sizes.tobytes(), held.tobytes(), count[count > 1].astype(np.uint32).tobytes()))
        return out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sets, size, sent_before = TaskContext.get().partitionId(), {}, [], 0, 0
        for _, raw, at in pieces(batches):
            for s in shingle_sets(raw, at)[0]:
                if len(s) and (i := set_id(s)) not in ids:
                    ids[i] = None
                    sets.append(s)
                    size += len(s)
                    if size >= CHUNK or len(sets) >= MOST:
                        yield rows_of(chunk_rows(list(ids), sets, f"{task}:{sent_before}:"))
                        ids, sets, size, sent_before = {}, [], 0, sent_before + 1
        if sets:
            yield rows_of(chunk_rows(list(ids), sets, f"{task}:{sent_before}:"))

    return docs.select("text").mapInArrow(emit, ROW)


def answered(blobs: DataFrame, ranges: int) -> DataFrame:
    """The blobs with the tokens alone that are owned more than once, and how often; own rows as they are."""

    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = [unpacked(a) for _, _, _, a, *_ in held]
        owners = [from_planes(b, 2, np.uint16) for _, _, _, _, b, *_ in held]
        sizes = [len(t) for t in tokens]
        times = [np.ones(k, np.int64) for k in sizes]
        for row, own, t in zip(held, owners, times, strict=True):
            t[own == SEVERAL] = np.frombuffer(row[5], np.uint32)
        token, weight = np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(token, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], token[order[1:]] != token[order[:-1]]]))
        total = np.empty(len(token), np.int64)
        total[order] = np.repeat(np.add.reduceat(weight[order], starts), np.diff(starts, append=len(token)))
        total = np.minimum(total, (1 << 32) - 1)
        out, at = [], 0
        for row, t, own, k in zip(held, tokens, owners, sizes, strict=True):
            f = total[at : at + k]
            at += k
            if (keep := f > 1).any():
                out.append((row[0], row[1], 0, packed(t[keep]), planes(own[keep], 2), f[keep].astype(np.uint32).tobytes(), None))
        if out:
            yield rows_of(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[2]:
                    yield rows_of([row])
                    continue
                if row[0] != part and held:
                    yield from answer(held)
                    held = []
                part = row[0]
                held.append(row)
        if held:
            yield from answer(held)

    return blobs.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(stream, ROW)


def listed(answers: DataFrame, ranges: int, percent: int) -> DataFrame:
    """id, n and the tokens (in the global order, 8 bytes each) of each chunk's classes that share enough for a link."""

    def lists(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = next((r for r in rows if r[2]), None)
        blobs = [r for r in rows if not r[2]]
        if own is None or not blobs:
            return
        tokens, owners, often = (np.concatenate(x) for x in ([unpacked(r[3]) for r in blobs], [from_planes(r[4], 2, np.uint16) for r in blobs], [np.frombuffer(r[5], np.uint32) for r in blobs]))
        several = np.flatnonzero(owners == SEVERAL)
        several = several[np.argsort(tokens[several])]  # all such tokens are answered, and the chunk's own row has them in this order
        times, alone = np.frombuffer(own[6], np.uint32), owners != SEVERAL
        owners = np.concatenate([owners[alone], np.frombuffer(own[5], np.uint16)])
        often = np.concatenate([often[alone], np.repeat(often[several], times)])
        tokens = np.concatenate([tokens[alone], np.repeat(tokens[several], times)])
        order = np.lexsort((tokens, often, owners))
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]]))
        begin, end, who = starts[:-1], starts[1:], owners[starts[:-1]].astype(np.int64)
        n = np.frombuffer(own[4], np.int64)[who]
        keep = end - begin >= least_overlap(n, percent)
        begin, end, who, n = begin[keep], end[keep], who[keep], n[keep]
        yield batch(
            "id n tokens", pa.array([own[3][16 * w : 16 * w + 16] for w in who.tolist()], pa.binary()), n,
            pa.array([tokens[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary()),
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[1] != chunk:
                    yield from lists(held)
                    held = []
                chunk = row[1]
                held.append(row)
        yield from lists(held)

    return answers.repartition(ranges, "chunk").sortWithinPartitions("chunk").mapInArrow(stream, "id binary, n long, tokens binary")


# --- points and trees ------------------------------------------------------------------------


def point(tokens: np.ndarray) -> bytes:
    """Counts of the token's leading bits in 16 or 64 groups of 16 bits each; finer points fold into coarser ones."""
    bits = GROUP_BITS
    while len(tokens) >> bits > MEAN and bits < MOST_BITS:
        bits += 2
    return np.minimum(np.bincount((tokens >> np.uint64(TOKEN_BITS - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint16).tobytes()


def unfolded(p: bytes) -> np.ndarray:
    row = np.frombuffer(p, np.uint16).astype(np.int64)
    row[row == FULL] = UNBOUNDED
    return row


def folded(points: list[bytes]) -> np.ndarray:
    """The points as rows of the coarsest one's groups; a full count stays no bound."""
    width = min(map(len, points)) // 2
    return np.stack([unfolded(p).reshape(width, -1).sum(1) for p in points])


def box(points: list[bytes]) -> bytes:
    """The maxima of points or boxes."""
    return np.minimum(folded(points).max(0), FULL).astype(np.uint16).tobytes()


def morton(p: bytes) -> bytes:
    """The Z-order code of a point: of 16 groups' shares, four bits each, the leading bits of all before the next ones."""
    c = unfolded(p).reshape(1 << GROUP_BITS, -1).sum(1)
    level = np.minimum(c * 4 * len(c) // max(int(c.sum()), 1), 15).astype(np.uint8)
    return np.packbits((level[None] >> np.array([[3], [2], [1], [0]], np.uint8)) & 1).tobytes()


def bounded(pairs: DataFrame, keep: list[str], percent: int) -> DataFrame:
    """The columns keep (longs) of the rows whose points pa and pb, of sets of at least na and nb shingles, allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb, p, q = (b.column(len(keep) + i) for i in range(4))
                bound = np.array([int(np.minimum(*folded([x, y])).sum()) for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)])
                yield b.select(keep).filter(pa.array((100 + percent) * bound >= percent * (na.to_numpy() + nb.to_numpy())))

    return pairs.select(*keep, "na", "nb", "pa", "pb").mapInArrow(check, ", ".join(f"{c} long" for c in keep))


def entries_of(lists: DataFrame, percent: int) -> DataFrame:
    """token, cid, n and pos of each class's first tokens that may be the first that a linked one shares."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, ids, sizes, places = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)]
            for cid, n, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = np.frombuffer(data, np.uint64)
                alone = n - len(t)
                t = t[: max(0, n - least_overlap(n, percent) + 1 - alone)]
                tokens.append(t)
                ids.append(np.full(len(t), cid))
                sizes.append(np.full(len(t), n))
                places.append(np.arange(alone, alone + len(t)))
            yield batch("token cid n pos", np.concatenate(tokens).view(np.int64), np.concatenate([places[0], *ids]), np.concatenate([places[0], *sizes]), np.concatenate(places))

    return lists.select("cid", "n", "tokens").mapInArrow(first, "token long, cid long, n long, pos long")


def points_of(lists: DataFrame) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [point(np.frombuffer(x, np.uint64)) for x in b.column(1).to_pylist()]
            yield batch("pid key point", b.column(0), pa.array(map(morton, p), pa.binary()), pa.array(p, pa.binary()))

    return lists.select("cid", "tokens").mapInArrow(mapped, "pid long, key binary, point binary")


MEMBER = "cid: long, n: long, room: long, component: long, point: binary"
#: A node: (token, level, node) names it, node being the first member's cid; the centre is the member of the most room.
NODE = (
    "token long, level int, node long, parent long, key binary, low long, high long, room long, component long, box binary, "
    f"center struct<cid: long, n: long, room: long, point: binary>, members array<struct<{MEMBER}>>"
)
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def arrow_struct(fields: str) -> pa.DataType:
    return pa.struct([(f.split(": ")[0], ARROW[f.split(": ")[1]]) for f in fields.split(", ")])


NODE_ARROW = pa.schema([
    *((n, ARROW[t]) for n, t in (c.split() for c in NODE.split(", center")[0].split(", "))),
    ("center", arrow_struct("cid: long, n: long, room: long, point: binary")), ("members", pa.list_(arrow_struct(MEMBER))),
])


def node_of(run: list[dict], level: int) -> dict:
    """The node above the rows of a run."""
    same = {r["component"] for r in run}
    return {
        "token": run[0]["token"], "level": level, "node": run[0]["node"], "parent": None, "key": run[0]["key"], "low": min(r["low"] for r in run), "high": max(r["high"] for r in run),
        "room": max(r["room"] for r in run), "component": same.pop() if len(same) == 1 else None, "box": box([r["box"] for r in run]),
        "center": max((r["center"] for r in run), key=lambda c: c["room"]) if level else (lambda r: {"cid": r["node"], "n": r["low"], "room": r["room"], "point": r["box"]})(max(run, key=lambda r: r["room"])),
        "members": [{"cid": r["node"], "n": r["low"], "room": r["room"], "component": r["component"], "point": r["box"]} for r in run] if level == 0 else None,
    }


class Level:
    """Packs the rows it gets, in order, into nodes, and these into the level above; each node goes to out once its parent is known."""

    def __init__(self, level: int, out: list[dict], leaf: int, fanout: int) -> None:
        self.level, self.out, self.leaf, self.fanout = level, out, leaf, fanout
        self.run: list[dict] = []
        self.only: dict | None = None
        self.above: Level | None = None

    def add(self, row: dict) -> None:
        if len(self.run) == (self.fanout if self.level else self.leaf):
            self.close()
        self.run.append(row)
        if self.level:
            self.out.append(row | {"parent": self.run[0]["node"]})

    def close(self) -> None:
        node, self.run = node_of(self.run, self.level), []
        if self.above is None and self.only is None:
            self.only = node
            return
        if self.above is None:
            self.above = Level(self.level + 1, self.out, self.leaf, self.fanout)
            self.above.add(self.only)
        self.above.add(node)

    def finish(self) -> None:
        self.close()
        if self.above:
            self.above.finish()
        else:
            self.out.append(self.only)


def packing(batches: Iterator[pa.RecordBatch], plant) -> Iterator[pa.RecordBatch]:
    """Nodes from rows that come sorted by token; plant(out) gives what takes a token's rows by add() and ends with finish()."""
    token, tree, out = None, None, []
    for b in batches:
        for row in b.to_pylist():
            if row["token"] != token:
                if tree:
                    tree.finish()
                token, tree = row["token"], plant(out)
            tree.add(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, NODE_ARROW)
            out.clear()
    if tree:
        tree.finish()
        yield pa.RecordBatch.from_pylist(out, NODE_ARROW)


class Forest:
    """One tree from the roots that a token's tree has in several tasks; lower roots are lifted by nodes of one child."""

    def __init__(self, out: list[dict], fanout: int) -> None:
        self.out, self.fanout, self.roots = out, fanout, []

    def add(self, row: dict) -> None:
        self.roots.append(row)

    def finish(self) -> None:
        height = max(r["level"] for r in self.roots)
        above = Level(height + 1, self.out, 0, self.fanout)
        for r in self.roots:
            while r["level"] < height:
                self.out.append(r | {"parent": r["node"]})
                r = node_of([r], r["level"] + 1)
            above.add(r)
        above.finish()


def merged_tasks(rows: DataFrame) -> DataFrame:
    """A union has the tasks of all its parts, and each would leave files in every shuffle that follows: as many as a shuffle has instead."""
    return rows.coalesce(partitions(rows.sparkSession))


def trees(entries: DataFrame) -> list[DataFrame]:
    """The nodes of all buckets' trees by level, from entries (token, cid, n, room, component, key, point).

    Entries are dealt by ranges of (token, key), and each task builds the trees of what it has. A token that lies in several
    tasks has a root in each; its tree is closed over these, at most one for each task.
    """
    rows = entries.select("token", F.col("cid").alias("node"), "key", F.col("n").alias("low"), F.col("n").alias("high"), "room", "component", F.col("point").alias("box"))
    dealt = rows.repartitionByRange(partitions(entries.sparkSession), "token", "key", "node").sortWithinPartitions("token", "key", "node")
    nodes = cut(dealt.mapInArrow(lambda b: packing(b, lambda out: Level(0, out, LEAF, FANOUT)), NODE))
    tops, inner = nodes.filter("parent is null"), nodes.filter("parent is not null")
    many = tops.groupBy("token").count().filter("count > 1").select("token")
    split = tops.join(many, "token").select(nodes.columns).repartition("token").sortWithinPartitions("token", "key", "node")
    nodes = cut(merged_tasks(inner.unionAll(tops.join(many, "token", "left_anti").select(nodes.columns)).unionAll(split.mapInArrow(lambda b: packing(b, lambda out: Forest(out, FANOUT)), NODE))))
    height = nodes.agg(F.max("level")).first()[0]
    return [nodes.filter(F.col("level") == k) for k in range((height or 0) + 1)]


def sized(rows: DataFrame, percent: int) -> DataFrame:
    """Rows whose sizes na and nb and rooms ra and rb (what follows the token in the order, itself included) allow a link."""
    fits = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return rows.filter(fits & ((100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))))


def upward(levels: list[DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b): each point with its leaf's centre, each node's centre with its parent's."""
    side = lambda at, s: [F.col(f"{at}.cid").alias("ab"[s]), F.col(f"{at}.n").alias(("na", "nb")[s]), F.col(f"{at}.room").alias(("ra", "rb")[s]), F.col(f"{at}.point").alias(("pa", "pb")[s])]
    rows = levels[0].filter("size(members) > 1").select("center", F.explode("members").alias("m")).select(*side("m", 0), *side("center", 1))
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        ends = low.select("token", "parent", F.col("center").alias("own")).join(high.select("token", F.col("node").alias("parent"), "center"), ["token", "parent"])
        rows = rows.unionAll(ends.select(*side("own", 0), *side("center", 1)))
    return bounded(sized(merged_tasks(rows).filter("a != b"), percent), ["a", "b"], percent).distinct()


def downward(levels: list[DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) of different components that no bound of the trees excludes: each tree joined with itself from its root."""
    met = None  # token, a, b: pairs of nodes of the level above
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].select("token", "node", "parent", "low", "high", "room", "component", "box")
        left = nodes.select("token", *(F.col(c).alias(f"{c}1") for c in nodes.columns[1:]))
        right = nodes.select("token", *(F.col(c).alias(f"{c}2") for c in nodes.columns[1:]))
        roots = levels[k].filter("parent is null and component is null").select("token", F.col("node").alias("a"), F.col("node").alias("b"))
        if met is not None:
            below = met.select("token", F.col("a").alias("parent1"), F.col("b").alias("parent2")).join(left, ["token", "parent1"]).join(right, ["token", "parent2"])
            below = below.filter("(parent1 != parent2 or node1 <= node2) and (component1 is null or component2 is null or component1 != component2)")
            below = below.filter((100 * F.col("high1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low1")) & ((100 + percent) * F.least("room1", "room2") >= percent * (F.col("low1") + F.col("low2"))))
            below = below.select("token", F.col("node1").alias("a"), F.col("node2").alias("b"), F.col("low1").alias("na"), F.col("low2").alias("nb"), F.col("box1").alias("pa"), F.col("box2").alias("pb"))
            roots = roots.unionAll(bounded(below, ["token", "a", "b"], percent))
        met = cut(merged_tasks(roots))
    leaves = levels[0].select("token", "node", "members")
    both = met.join(leaves.select("token", F.col("node").alias("a"), F.col("members").alias("m1")), ["token", "a"]).join(leaves.select("token", F.col("node").alias("b"), F.col("members").alias("m2")), ["token", "b"])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros((0, 2), np.int64)]
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = folded([m["point"] for m in (*x, *y)])
                p, q = p[: len(x)], p[len(x) :]
                (i1, n1, r1, c1), (i2, n2, r2, c2) = ([np.array([m[k] for m in s]) for k in ("cid", "n", "room", "component")] for s in (x, y))
                need = percent * (n1[:, None] + n2)
                fits = (c1[:, None] != c2) & (100 * np.minimum(n1[:, None], n2) >= percent * np.maximum(n1[:, None], n2)) & ((100 + percent) * np.minimum(r1[:, None], r2) >= need)
                for k in np.flatnonzero(fits.any(1)):
                    j = np.flatnonzero(fits[k] & ((100 + percent) * np.minimum(p[k], q).sum(1) >= need[k]))
                    out.append(np.stack([np.minimum(i1[k], i2[j]), np.maximum(i1[k], i2[j])], 1))
            ends = np.unique(np.concatenate(out), axis=0)
            yield batch("a b", ends[:, 0], ends[:, 1])

    return both.select("m1", "m2").mapInArrow(survivors, "a long, b long").distinct()


# --- verification -----------------------------------------------------------------------------


def verified(lists: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: 100 * shared >= percent * (both - shared).

    A task has a class and up to PAIRS_PER_TASK others; a list goes once to each task that compares it. If the pairs name at most FEW
    classes, these are broadcast to the lists instead of dealing all lists.
    """
    many = pairs.groupBy(F.col("b").alias("center")).agg(F.ceil(F.count("*") / PAIRS_PER_TASK).alias("parts"))
    pairs = cut(pairs.join(many, F.col("b") == F.col("center")).select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("task")))
    sides = pairs.select("task", F.explode(F.array("a", "b")).alias("cid")).distinct()
    if pairs.count() <= FEW:
        sides = F.broadcast(sides)
    none = F.lit(None)
    rows = lists.join(sides, "cid").select("task", "cid", none.cast("long").alias("b"), "n", "tokens")
    rows = rows.unionAll(pairs.select("task", F.col("a").alias("cid"), "b", none.cast("long"), none.cast("binary")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for x in batches:
            left, right = [], []
            for t, i, b, n, tokens in zip(*(x.column(k).to_pylist() for k in range(5)), strict=True):
                if t != task:
                    task, held = t, {}
                if b is None:
                    held[i] = (n, np.frombuffer(tokens, np.uint64))
                else:
                    (n1, p), (n2, q) = held[i], held[b]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * shared >= percent * (n1 + n2 - shared):
                        left.append(i)
                        right.append(b)
            yield batch("a b", pa.array(left, pa.int64()), pa.array(right, pa.int64()))

    return merged_tasks(rows).repartition("task").sortWithinPartitions("task", F.col("b").isNotNull()).mapInArrow(compare, "a long, b long")


# --- the join ---------------------------------------------------------------------------------


def grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The profiles, and for each class with a doc_id: nid (its set), first (its least doc_id), component, component_id."""
    docs = docs.select("doc_id", "text")
    profile = cut(profiles(docs))
    classes = profile.filter("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.min("n").alias("size"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = profile.agg(F.sum("n")).first()[0] or 0
    ranges = max(partitions(docs.sparkSession), -(-total // RANGE))
    raw = listed(answered(sent(docs.filter("doc_id is not null"), ranges), ranges), ranges, percent)
    lists = cut(raw.dropDuplicates(["id"]).join(classes, "id").select("cid", raw["n"], "tokens"))  # a class of several chunks has one list

    first = cut(entries_of(lists, percent))
    members = F.struct(F.count("*"), F.bit_xor(F.xxhash64("cid")), F.sum(F.shiftright(F.xxhash64("cid", F.lit(1)), 24)))
    buckets = first.groupBy("token").agg(F.min("n").alias("least"), F.count("*").alias("many"), F.xxhash64(members).alias("bucket")).filter("many > 1")
    # tokens of one set of classes are one bucket, in which a class has its most room; were two sets mistaken for one, more would be compared
    merged = first.join(buckets, "token").groupBy("bucket", "cid").agg(F.max(F.col("n") - F.col("pos")).alias("room"), F.min("least").alias("least"), F.min("n").alias("n"))
    kept = merged.filter(percent * (F.col("least") + F.col("n")) <= (100 + percent) * F.col("room"))  # else not even the least of the bucket may be linked
    points = points_of(lists)
    entries = cut(kept.join(points, F.col("cid") == F.col("pid")).select(F.col("bucket").alias("token"), "cid", "n", "room", "key", "point"))

    links = cut(verified(lists, cut(upward(trees(entries.withColumn("component", F.col("cid"))), percent)), percent))
    groups = cut(connected_components(links, "a", "b").select(F.col("id").alias("gid"), "component"))
    joined = cut(entries.join(groups, F.col("cid") == F.col("gid"), "left").withColumn("component", F.coalesce("component", "cid")).drop("gid"))
    several = joined.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select("token")
    more = cut(downward(trees(joined.join(several, "token")), percent))
    links = merged_tasks(links.unionAll(cut(verified(lists, more, percent))))
    groups = connected_components(links, "a", "b").select(F.col("id").alias("gid"), "component")
    linked = cut(classes.join(groups, F.col("cid") == F.col("gid"), "left").withColumn("component", F.coalesce("component", "cid")))
    least = cut(linked.groupBy("component").agg(F.min("first").alias("component_id")))  # by itself, so that a large component's classes may be split
    return profile, linked.join(least, "component").select(F.col("id").alias("nid"), "first", "component", "component_id")


def linked(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, for every document.

    Words are A-Z-lower-cased runs without white space; fewer than five make one shingle. Two documents link when
    100 * shared >= percent * of both. Defined cases: null, empty and blank texts have no shingles and are their own
    component; repeated rows are each returned; rows without a doc_id have no component unless their text has copies with one; an empty
    table gives an empty result; other columns are ignored.
    """
    profile, named = grouped(docs, percent)
    out = profile.join(named, (F.col("id") == F.col("nid")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def identified(docs: DataFrame, digest: str, size: str) -> DataFrame:
    """Adds the digest of the row's set of shingles and its size, under these names."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches):
            sets, _ = shingle_sets(raw, at)
            added = [pa.array(map(set_id, sets), pa.binary()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, digest, size])

    return docs.mapInArrow(sets_of, StructType([*docs.schema.fields, StructField(digest, BinaryType()), StructField(size, LongType())]))


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group that links join, of the least doc_id, with all columns. Rows without text stay.

    Repeated rows, and rows of one doc_id whose texts differ, are judged by their texts. Rows without a doc_id give way to copies
    with one; of copies that all have none one row stays.
    """
    profile, named = grouped(docs, percent)
    best = named.groupBy("component").agg(F.min(F.struct("first", "nid")).alias("m")).select("m.nid", "m.first")
    lone = profile.filter("n > 0 and doc_id is null").select(F.col("id").alias("nid")).distinct().join(named.select("nid"), "nid", "left_anti")
    best = best.unionAll(lone.select("nid", F.lit(None).cast("long").alias("first")))
    *keys, size, kept, nth = names = free_names(docs, "set_id", "set_doc", "set_no_doc", "set_size", "set_kept", "set_row")
    best = best.select(F.col("nid").alias(keys[0]), F.coalesce("first", F.lit(0)).alias(keys[1]), F.col("first").isNull().alias(keys[2]), F.lit(1).alias(kept))
    rows = identified(docs, keys[0], size).withColumn(keys[1], F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn(keys[2], F.col("doc_id").isNull())
    rows = rows.join(best, keys, "left").filter((F.col(size) == 0) | (F.col(kept) == 1))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))))
    return rows.filter((F.col(size) == 0) | (F.col(nth) == 1)).drop(*names).select(*docs.columns)
