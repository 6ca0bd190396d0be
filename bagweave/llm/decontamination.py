"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the number of their 5-word shingles into classes (u/2, u]. For a class, documents
are cut into windows of 2u shingles every u shingles, so a short item inside a long document is a fair
share of some window, however long the document is. Items and windows have MinHash signatures of
FUNCTIONS values; one equal value makes a candidate. Windows of one class are merged pairwise for the next, so each
shingle is hashed once for each function. With containment of 0.75 the Jaccard similarity of an item and
its window is at least 0.18, so a passage that stands in one place is missed with a chance below 4e-6.

What signatures may miss (that chance, and shingles that lie scattered over a document) is found by rarest sketches: of an item of n
shingles of which k must be shared, a document that qualifies holds one of any n - k + 1; those that the fewest items of the block have are
taken, ties by the first hash function. These are few, each is looked up in the document's shingles, and no pair is missed. So a signature value that more
than COMMON items share, such as that of a stem that many questions begin with, is left to the sketches. Every candidate is
verified by counting the item's shingles in the document.

Items come in blocks of BLOCK_SHINGLES shingles, or of one item that has more; each block is a stated query set against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.llm.common import WORD, cut, pieces, run_hashes, shingle_sets, span_hashes, word_spans

THRESHOLD = 0.75
FUNCTIONS = 64
SMALL = 4
FIRST_CLASS = 8
#: Words of the items that one pass over the documents searches for, on average; and blocks whose indexes are in memory at once.
BLOCK_WORDS, LIVE_BLOCKS = 2_000_000, 4
#: Items that a signature value may have to be looked up.
COMMON = 16
MATCHES = "doc_id long, item_id long, n_shared long, n_item long, containment double"

_rng = np.random.default_rng(7)
FACTORS = (_rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


class Items:
    """A block of items: how often each is in the table, their shingle sets, per class and function the signature values with the items that
    have them, and the bottom sketches."""

    def __init__(self, ids: list[int], times: list[int], sets: list[np.ndarray], threshold: float) -> None:
        self.ids, self.times, self.sets = ids, times, sets
        self.levels: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        by_level: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_level.setdefault(-1 if len(s) <= SMALL else max(0, int(np.ceil(np.log2(len(s) / FIRST_CLASS)))), []).append(i)
        for level, own in by_level.items():
            if level < 0:
                values, who = np.concatenate([sets[i] for i in own]), np.repeat(own, [len(sets[i]) for i in own])
                self.levels[level] = [self.index(values, who, COMMON)]
            else:
                signatures = np.array([[(sets[i] * a + b).min() for i in own] for a, b in zip(FACTORS, TERMS, strict=True)])
                self.levels[level] = [self.index(v, np.array(own), COMMON) for v in signatures]
        # shingles that few items of the block have come first, so that a stem that many items share is in few sketches
        known, place, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        often = times[place] if len(known) else place
        ends = np.cumsum([len(s) for s in sets])
        few = [s[np.lexsort((s * FACTORS[0] + TERMS[0], often[e - len(s) : e]))[: len(s) - int(np.ceil(threshold * len(s))) + 1]] for s, e in zip(sets, ends, strict=True)]
        self.bottom = self.index(np.concatenate([np.zeros(0, np.uint64), *few]), np.repeat(np.arange(len(sets)), [len(f) for f in few]))

    @staticmethod
    def index(values: np.ndarray, who: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in order with their items, behind a map of their upper bits; values of more than ``most`` items are left out."""
        order = np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        if most is not None and len(values):
            rare = np.searchsorted(values, values, "right") - np.searchsorted(values, values, "left") <= most
            values, who = values[rare], who[rare]
        seen = np.zeros(1 << 16, bool)
        seen[(values >> np.uint64(48)).astype(np.int64)] = True
        return seen, values, who

    @staticmethod
    def found(index: tuple[np.ndarray, np.ndarray, np.ndarray], windows: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row and item, packed, of the windows whose value an item has; each pair once."""
        seen, values, who = index
        maybe = np.flatnonzero(seen[(windows >> np.uint64(48)).astype(np.int64)])
        left, right = np.searchsorted(values, windows[maybe], "left"), np.searchsorted(values, windows[maybe], "right")
        n = right - left
        to = np.cumsum(n)
        item = who[np.arange(n.sum()) + np.repeat(left - (to - n), n)] if n.any() else np.zeros(0, np.int64)
        return np.unique((np.repeat(row[maybe], n).astype(np.int64) << 32) | item)

    def candidates(self, hashes: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """hashes: the shingles in order; row: of each, ascending."""
        if not len(hashes):
            return set()
        packed = [self.found(self.bottom, hashes, row)]
        if -1 in self.levels:
            packed.append(self.found(self.levels[-1][0], hashes, row))
        self.windows(hashes, row, packed)
        return {(int(x >> 32), int(x & 0xFFFFFFFF)) for x in np.unique(np.concatenate(packed))}

    def windows(self, hashes: np.ndarray, row: np.ndarray, packed: list[np.ndarray]) -> None:
        top = max(self.levels, default=-1)
        if top < 0:
            return
        change = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        length = np.diff(np.concatenate([change, [len(row)]]))
        place = np.arange(len(row)) - np.repeat(change, length)
        starts = np.flatnonzero(place % FIRST_CLASS == 0)
        plan, block_row = [], row[starts]
        for level in range(top + 1):
            alone = np.concatenate([block_row[1:] != block_row[:-1], [True]])
            first = np.concatenate([[0], np.flatnonzero(alone[:-1]) + 1])
            count = np.diff(np.concatenate([first, [len(block_row)]]))
            odd = np.arange(len(block_row)) - np.repeat(first, count)
            merge = np.flatnonzero(odd % 2 == 0)
            plan.append((alone, block_row, merge))
            block_row = block_row[merge]
        for f in range(FUNCTIONS):
            blocks = np.minimum.reduceat(hashes * FACTORS[f] + TERMS[f], starts)
            for level, (alone, rows, merge) in enumerate(plan):
                if level in self.levels:
                    windows = blocks.copy()
                    np.minimum(windows[:-1], blocks[1:], out=windows[:-1], where=~alone[:-1])
                    packed.append(self.found(self.levels[level][f], windows, rows))
                blocks = np.minimum.reduceat(blocks, merge)


def matches(items: Items, raw: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(row, index of the item, shared shingles) of all pairs at or above the threshold."""
    starts, ends, row = word_spans(raw, at)
    hashes, first = run_hashes(span_hashes(raw, starts, ends), row, 5)
    owner = row[first]
    count = np.bincount(row, minlength=len(at) - 1)
    pairs = items.candidates(hashes, owner)
    short: dict[int, np.ndarray] = {}
    for i in np.flatnonzero((count > 0) & (count < 5)):  # a text of fewer words is one shingle
        short[int(i)] = shingle_sets(raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))[0][0]
        if -1 in items.levels:
            pairs.update((int(i), int(x)) for index in (items.levels[-1][0], items.bottom) for x in items.found(index, short[int(i)], np.zeros(1, np.int64)))
    out: list[tuple[int, int, int]] = []
    place = np.searchsorted(owner, np.arange(len(at)))
    held, of = np.zeros(0, np.uint64), -1
    for i, j in sorted(pairs):
        if i != of:
            held, of = short[i] if i in short else np.unique(hashes[place[i] : place[i + 1]]), i
        n = int(np.isin(items.sets[j], held, assume_unique=True).sum())
        if n >= threshold * len(items.sets[j]):
            out.append((i, j, n))
    return out


def item_blocks(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """The items, equal rows once with their number, in blocks by hash; the driver holds one block at a time."""
    items = benchmark.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        yield Items(rows.column("item_id").to_pylist(), rows.column("times").to_pylist(), shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at)[0], threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every document and item of which it holds at least the threshold's share of shingles.

    Words are A-Z-lower-cased runs without white space; fewer than five words make one shingle. Defined cases: null or
    empty texts and items match nothing; repeated rows each give rows; empty tables give an empty result; other columns are ignored.
    """
    context, out, live = docs.sparkSession.sparkContext, None, []
    for block in item_blocks(benchmark, threshold):
        shared = context.broadcast(block)
        live.append(shared)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for rows, raw, at in pieces(batches):
                found = [(rows.column(0)[i].as_py(), items.ids[j], n, len(items.sets[j]), n / len(items.sets[j])) for i, j, n in matches(items, raw, at, threshold) for _ in range(items.times[j])]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int64(),) * 4 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        leaks = docs.select("doc_id", "text").mapInArrow(search, MATCHES)
        out = leaks if out is None else out.unionAll(leaks)
        if len(live) == LIVE_BLOCKS:
            out = settled(out, live)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; they are filtered where they are read."""
    live = []
    for block in item_blocks(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        live.append(shared)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, raw, at in pieces(batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[i for i, _, _ in matches(shared.value, raw, at, threshold)]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if len(live) == LIVE_BLOCKS:
            docs = settled(docs, live)
    return docs


def settled(rows: DataFrame, live: list[Broadcast]) -> DataFrame:
    """The rows computed, so that the blocks they needed can go."""
    rows = cut(rows)
    for shared in live:
        shared.unpersist()
    live.clear()
    return rows
