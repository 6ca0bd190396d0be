"""Best-fit packing of tokenised documents into sequences of a fixed size, planned on lengths.

Texts become token ids in tasks; each piece is written with its length and its number among the pieces of that length in its task.
Lengths are at most the size of a sequence, so their histogram has a bounded number of rows, however many documents there are: it alone
goes to the driver, where ``plan`` packs counts, not documents. From the longest length down, it fills the gap beside a length exactly
by one, two or three available lengths (exact complements, found by an index of the sums of one, two and three lengths), as many
times as the counts allow; what has no complement goes by best fit, and the gap that it leaves is looked up again.
Pieces learn their place by a running count of each length over tasks.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagweave.llm.common import cut, free_names, pieces

#: Tokens of a sequence, and the id behind each document.
SIZE, END = 2048, 0
#: Text that is tokenised at once, in bytes; a worker forgets the ids of its chunks once it has so many of them, or so many bytes.
TEXT_BYTES, KEPT, KEPT_BYTES = 1 << 22, 500_000, 1 << 24
#: Chunks that are encoded in a row, and such rows, or chunks alone, at once.
TOGETHER, AT_ONCE = 64, 256


LETTER, MARK, INK = (np.zeros(256, bool) for _ in range(3))
LETTER[[*range(65, 91), *range(97, 123)]] = True
INK[0x21:0x7F] = True
MARK[0x21:0x7F] = ~LETTER[0x21:0x7F]
MARK[[0x27, *range(48, 58)]] = False

# --- tokens -----------------------------------------------------------------------------------


class Tokens:
    """Token ids of texts by way of their distinct chunks.

    A text is cut before each space between two characters of ASCII or of two bytes that aren't white space, between an ASCII letter and a mark (but
    for an apostrophe), and between a single line end and a letter. A byte-level tokenizer with the usual pattern
    starts a new piece there whatever stands around, so the ids of the chunks one after another are those of the text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():  # a character of a byte-level token is a byte
            self.bytes_of[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))

    def known(self, chunks: pa.Array) -> np.ndarray:
        """Where the ids of the distinct chunks are; those that aren't there yet are added."""
        at = pc.index_in(chunks, value_set=self.chunks)
        if at.null_count:
            if len(self.chunks) > KEPT or self.chunks.nbytes > KEPT_BYTES:
                self.forget()
                fresh = chunks
            else:
                fresh = chunks.filter(at.is_null())
            self.chunks = pa.concat_arrays([self.chunks, fresh])
            self.ids = pa.concat_arrays([self.ids, self.encoded(fresh)])
            at = pc.index_in(chunks, value_set=self.chunks)
        return at.to_numpy()

    def encoded(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk. Chunks are encoded many in a row, as their ids don't depend on it, and told apart by the bytes of their tokens; those at the ends of texts alone."""
        inner = pc.match_substring_regex(chunks, r"^ [!-~\x{C0}-\x{7FF}](.*[!-~\x{C0}-\x{7FF}])?$").to_numpy(zero_copy_only=False)
        size = pc.binary_length(chunks).to_numpy()
        order = np.argsort(~inner, kind="stable")
        whole = chunks.take(pa.array(order[: inner.sum()]))
        edges = np.concatenate([np.arange(0, len(whole), TOGETHER), [len(whole)]])
        joined = ["".join(whole.slice(a, b - a).to_pylist()) for a, b in zip(edges, edges[1:], strict=False)]
        alone = chunks.take(pa.array(order[inner.sum() :])).to_pylist()
        flat = np.concatenate([self.flat_ids(some, i, AT_ONCE) for some in (joined, alone) for i in range(0, len(some), AT_ONCE)] or [np.zeros(0, np.uint32)])
        ends = np.cumsum(self.bytes_of[flat])
        place = np.searchsorted(ends, np.cumsum(size[order])) + 1 if len(flat) else np.zeros(len(size), np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.where(np.cumsum(size[order]) > 0, place, 0)])), pa.array(flat))
        return lists.take(pa.array(np.argsort(order, kind="stable")))

    def flat_ids(self, texts: list[str], begin: int, n: int) -> np.ndarray:
        """The ids of n of the texts; what the tokenizer tells besides takes a hundred times their memory."""
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts[begin : begin + n], add_special_tokens=False)), np.uint32)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place of each row's first one."""
        space = np.flatnonzero(raw == 0x20)
        space = space[(space > 1) & (space < len(raw) - 1)]
        before, after = raw[space - 1], raw[space + 1]
        opens = (after > 0x20) & (after < 0x80) | (after >= 0xC3) & (after <= 0xDF)
        closes = (before > 0x20) & (before < 0x80) | (before >= 0x80) & (raw[space - 2] >= 0xC3) & (raw[space - 2] <= 0xDF)
        edge = np.zeros(len(raw) + 1, bool)
        edge[space[opens & closes]] = True
        edge[1:-1][MARK[raw[1:]] & LETTER[raw[:-1]]] = True
        edge[2:-1][LETTER[raw[2:]] & (raw[1:-1] == 0x0A) & INK[raw[:-2]]] = True
        edge[at] = True
        bounds = np.flatnonzero(edge)
        chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        where = self.known(chunks.dictionary)
        ids = self.ids.take(pa.array(where[chunks.indices.to_numpy()]))
        to = ids.offsets.to_numpy()
        return ids.values.to_numpy(), to[np.searchsorted(bounds, at)]


_tokens: dict[str, Tokens] = {}


def tokenised(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Each piece of each document: doc_id, piece, start, length, ids_crc32, and task and nth (its number among the task's pieces of its length)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.setdefault(path, Tokens(path)) if path not in _tokens else _tokens[path]
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for rows, raw, at in pieces(batches, size=TEXT_BYTES):
            ids, place = tokens(raw, at)
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4").tobytes()
                n = len(own) // 4
                first = n % size or size
                begins = [0, *range(first, n, size)]
                row += [i] * len(begins)
                piece += range(len(begins))
                start += begins
                ends = [*begins[1:], n]
                length += [e - s for s, e in zip(begins, ends, strict=True)]
                crc += [zlib.crc32(own[4 * s : 4 * e]) for s, e in zip(begins, ends, strict=True)]
            size_of = np.array(length, np.int64)
            order = np.argsort(size_of, kind="stable")
            run = size_of[order]
            nth = np.empty(len(run), np.int64)
            nth[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
            seen += np.bincount(size_of, minlength=size + 1)
            doc = rows.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size_of), pa.array(crc, pa.int64()), pa.array(np.full(len(run), task, np.int32)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


# --- the plan ---------------------------------------------------------------------------------


@dataclass
class Bins:
    """``count`` sequences of one content: runs of (length, copies) in order."""

    content: tuple[tuple[int, int], ...]
    count: int


class Index:
    """Which sums one, two and three available lengths have. Whole counts of ordered pairs and triples are kept as lengths run out."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        n = len(counts)
        self.one = (counts > 0).astype(np.int64)
        lengths = np.flatnonzero(self.one)
        self.two, self.three = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x in lengths:
            self.two += self._moved(self.one, x)
        for x in lengths:
            self.three += self._moved(self.two, x)

    def _moved(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        if by < len(values):
            out[by:] = values[: len(values) - by]
        return out

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if n and not self.counts[length]:
            unit = np.zeros_like(self.one)
            unit[0] = 1
            m = lambda values, times: self._moved(values, times * length)
            self.three += 3 * m(self.one, 2) - 3 * m(self.two, 1) - m(unit, 3)
            self.two += m(unit, 2) - 2 * m(self.one, 1)
            self.one[length] = 0

    def _free(self, *lengths: int) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def complement(self, gap: int) -> tuple[tuple[int, ...], int] | None:
        """One, two or three lengths, longest first, that fill the gap, and how often they are there."""
        if gap <= 0:
            return None
        if self.one[gap]:
            return (gap,), int(self.counts[gap])
        if self.two[gap]:
            for x in np.flatnonzero(self.one[(gap + 1) // 2 : gap] & self.one[gap // 2 : 0 : -1][: gap - (gap + 1) // 2]) + (gap + 1) // 2:
                if n := self._free(int(x), gap - int(x)):
                    return (int(x), gap - int(x)), n
        if self.three[gap]:
            for x in np.flatnonzero(self.one[1:gap] & (self.two[gap - 1 : 0 : -1] > 0))[::-1] + 1:
                x, rest = int(x), gap - int(x)
                low = np.flatnonzero(self.one[1:rest] & self.one[rest - 1 : 0 : -1]) + 1
                for y in low[low >= rest - low]:
                    if n := self._free(x, int(y), rest - int(y)):
                        return tuple(sorted((x, int(y), rest - int(y)), reverse=True)), n
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[Bins]:
    """Sequences that take ``counts`` pieces of each length, grouped by content; the steps depend on the distinct lengths, not on the counts.

    Exact complements can use up short lengths that best fit alone would have spread better: the plan with fewer sequences counts.
    """
    return min((planned(counts, size, exact) for exact in (True, False)), key=lambda bins: sum(b.count for b in bins))


def planned(counts: dict[int, int], size: int, exact: bool) -> list[Bins]:
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    index = Index(have)
    done: list[Bins] = []
    open_: dict[int, list[Bins]] = {}
    gaps: list[int] = []  # sorted

    def close_or_open(content: tuple[tuple[int, int], ...], gap: int, n: int) -> None:
        """n sequences with this gap: exact complements fill what they can, the others stay open."""
        while n and exact and (found := index.complement(gap)):
            lengths, most = found
            k = min(n, most)
            for x in lengths:
                index.take(x, k)
            done.append(Bins((*content, *((x, 1) for x in lengths)), k))
            n -= k
        if n and gap:
            if gap not in open_:
                gaps.insert(bisect_right(gaps, gap), gap)
            open_.setdefault(gap, []).append(Bins(content, n))
        elif n:
            done.append(Bins(content, n))

    for length in range(size, 0, -1):
        while n := int(have[length]):
            if length == size:
                index.take(length, n)
                done.append(Bins(((length, 1),), n))
                continue
            found = index.complement(size - length) if exact else None
            # an exact partner of its own length needs two of them
            if found and (k := min(n // (1 + found[0].count(length)), found[1])):
                index.take(length, k)
                for x in found[0]:
                    index.take(x, k)
                done.append(Bins(((length, 1), *((x, 1) for x in found[0])), k))
                continue
            at = bisect_right(gaps, length - 1)
            if at < len(gaps):
                gap = gaps[at]
                bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, bins = size, Bins((), n)
            each = gap // length
            full = min(bins.count, n // each)
            some = n - full * each if full < bins.count and n - full * each < each else 0
            index.take(length, full * each + some)
            if left := bins.count - full - (some > 0):
                if bins.content:
                    if gap not in open_:
                        gaps.insert(bisect_right(gaps, gap), gap)
                    open_.setdefault(gap, []).append(Bins(bins.content, left))
            if some:
                close_or_open((*bins.content, (length, some)), gap - some * length, 1)
            if full:
                close_or_open((*bins.content, (length, each)), gap - each * length, full)
    return done + [b for bins in open_.values() for b in bins]


@dataclass
class Places:
    """Where the pieces of a length go, by their number: arrays of intervals, sorted by length and first number."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def places(bins: list[Bins]) -> Places:
    rows, used, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length, copies in b.content:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * b.count
            offset += length * copies
        sequence += b.count
    rows.sort()
    return Places(*(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5)))


def placed(numbered: DataFrame, where: Places) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length and a number ``rank`` among those of that length."""
    starts = np.searchsorted(where.length, np.arange(int(where.length.max(initial=0)) + 2))

    def put(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                lo, hi = starts[x], starts[x + 1]
                at[own] = lo + np.searchsorted(where.first[lo:hi], rank[own], side="right") - 1
            since, copies = rank - where.first[at], where.copies[at]
            keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(where.sequence[at] + since // copies), pa.array(where.offset[at] + since % copies * length)], [f.name for f in batch.schema if f.name != "rank"] + ["sequence_id", "offset"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank"]
    return numbered.mapInArrow(put, ", ".join([*columns, "sequence_id long", "offset long"]))


def numbered(rows: DataFrame) -> DataFrame:
    """Pieces with a rank among all of their length, from their number inside their task and the counts of the tasks before."""
    sums = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("length", "task", before.alias("base"))
    return rows.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("task", "nth", "base")


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    tokenizer: the path of a byte-level tokenizer's file, readable on every executor.

    Defined cases: a null or empty text is the end id alone; a null doc_id and repeated rows are documents of their own; ties (pieces of one length) go in the order
    of tasks and rows; only a document longer than a sequence is cut, and its first piece takes what full ones leave; an empty
    table gives no rows; other columns are ignored. The driver holds the histogram of lengths and the plan, ``size`` rows and a few times as many at most.
    """
    rows = cut(tokenised(docs, tokenizer, size))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = placed(numbered(rows), places(plan(counts, size)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """sequence_id, n_tokens, pieces (offset, doc_id, piece, start, length, in order): what a loader reads; a sequence has ``size`` tokens at most."""
    piece, = free_names(docs.select(), "p")
    one = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed(docs, tokenizer, size).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(one.alias(piece))).alias("pieces"))
