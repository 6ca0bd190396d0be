"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts earlier are removed.

The suffix arrays are built by linear grouping (`suffix_order`): suffixes are grouped by their Lyndon
prefixes, groups being processed in descending order with pointers to the previous smaller suffix; then each
group's order is emitted in one pass, without recursive renaming.

To build them only over what can repeat, every string of SPAN bytes has an anchor, the leftmost least hash of its
GRAM-byte strings; equal strings have equal anchors at equal offsets. Strings that share an anchor form a run, and its bytes are the
anchor's context. Runs are dealt by anchor:

*   A context that also starts earlier is removed whole (repeats of equal contexts collapse where they are read, so
    a text with many copies is no hot key).
*   The first of each of several contexts with one anchor, cut into the strings that hold HALF bytes left of the anchor and the others,
    goes to suffix arrays over the cut contexts that share those bytes too. Neighbours in the suffix order that agree in SPAN bytes are
    one string, of which all but the earliest start are removed.
*   The contexts of an anchor with more than BLOCK of them are dealt over blocks with a suffix array each; the earliest
    starts of the blocks meet by the digest of their string.

Positions are on the input texts. The texts themselves are dealt only if something is removed from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.llm.common import BASE, BYTE, INVERSE, cut, members, mix, pieces, powers, text_bytes

SPAN, GRAM = 100, 32
HALF = (SPAN - GRAM) // 2
#: Contexts of one anchor that one suffix array takes; with FAN times as many they are dealt over FAN times as many blocks.
BLOCK, FAN, LEVELS = 1024, 8, 8
#: Places a run's number of strings takes.
PLACES = 128
#: Bytes that one suffix array takes, but for a single group.
ARRAY_BYTES = 1 << 16
#: Keys that a filter is broadcast for (a bit map of 32 bits a key, 32 MB at most); beyond, documents are joined with what is wanted of them.
FILTERED = 1 << 23
#: Stands for a null doc_id, which counts as the last.
LAST = (1 << 63) - 1
CHUNK = 1 << 25


def suffix_order(text: list[int]) -> list[int]:
    """The suffix array of a list of small integers that ends in a 0 found nowhere else.

    Every suffix is looked at and moved a bounded number of times; groups are sorted by position, which adds a logarithm of their size.
    """
    n = len(text)
    codes = np.array(text)
    by_char = np.argsort(codes, kind="stable")
    chars = codes[by_char]
    first = np.concatenate([[True], chars[1:] != chars[:-1]]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group = np.empty(n, np.int64)
    group[by_char] = begin
    place = np.empty(n, np.int64)
    place[by_char] = np.arange(n)
    order, group, place = by_char.tolist(), group.tolist(), place.tolist()
    size = np.bincount(begin, minlength=n).tolist()
    smaller = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        count: dict[int, int] = {}
        for s in sorted(order[start:end]) if end - start > 1 else (order[start],):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and size[group[p]] > 1:  # alone in its group, it stays where it is
                count[p] = count.get(p, 0) + 1
        end = start
        if not count:
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in count.items():
            by_count.setdefault(c, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved = by_count[k]
            for p in moved:
                g = group[p]
                left = size[g] - 1
                size[g] = left
                last, at = g + left, place[p]
                other = order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
            for p in moved:
                g = group[p]
                g += size[g]
                group[p] = g
            for p in moved:
                size[group[p]] += 1
    free = list(range(n))
    out = [-1] * n
    placed = bytearray(n)
    if n:
        out[0] = n - 1
        placed[n - 1] = 1
        free[0] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def repeated_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All SPAN-byte strings of the texts in suffix order: text, start in it, and a number equal for equal strings."""
    lengths = np.array([len(t) for t in texts])
    joined = np.concatenate([np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)]).astype(np.int64) + 2
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    joined[begins + lengths] = 1
    order = np.array(suffix_order([*joined.tolist(), 0]))[1:]
    owner = np.searchsorted(begins, order, side="right") - 1
    start = order - begins[owner]
    inside = start + SPAN <= lengths[owner]
    order, owner, start = order[inside], owner[inside], start[inside]
    if not len(order):
        return owner, start, start
    windows = np.lib.stride_tricks.sliding_window_view(joined.astype(np.int16), SPAN)
    new = np.ones(len(order), bool)
    for i in range(1, len(order), 20_000):
        j = min(len(order), i + 20_000)
        new[i:j] = (windows[order[i:j]] != windows[order[i - 1 : j - 1]]).any(1)
    return owner, start, np.cumsum(new) - 1


class Runs:
    """The anchors of some texts: place of the anchor, first and last start of its run, key of the anchor, hash of the context."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)
        if n < SPAN:
            self.place = self.first = self.last = self.row = np.zeros(0, np.int64)
            self.key = self.context = np.zeros(0, np.uint64)
            return
        grams = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        width, windows = SPAN - GRAM + 1, n - SPAN + 1
        anchor = np.empty(windows, np.int64)
        low = np.uint64(2 * CHUNK - 1)
        for c in range(0, windows, CHUNK):
            part = grams[c : min(c + CHUNK, windows) + width - 1]
            least, step = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
            while step * 2 <= width:
                least, step = np.minimum(least[:-step], least[step:]), step * 2
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
            anchor[c : c + CHUNK] = (least & low).astype(np.int64) + c
        end = np.repeat(at[1:], np.diff(at))[:windows]
        starts = np.flatnonzero(np.arange(windows) + SPAN <= end)
        own = anchor[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
        k = np.flatnonzero(new)
        self.place, self.first = own[k], starts[k]
        self.last = starts[np.concatenate([k[1:], [len(starts)]]) - 1] if len(k) else starts
        self.row = np.searchsorted(at, self.first, side="right") - 1
        self.key = grams[self.place]
        self.context = mix(self.hashes(self.first, self.last + SPAN) + (self.place - self.first).astype(np.uint64))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_mark(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) + first.astype(np.uint64)).view(np.int64)


def doc_ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def all_runs(docs: DataFrame) -> DataFrame:
    """key, context, doc, first, n (strings of the run; negative: an equal context is earlier, as seen where it was read)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches):
            runs = Runs(raw, at)
            doc = doc_ids(rows)[runs.row]
            first = runs.first - at[runs.row]
            order = np.lexsort((first, doc, runs.context, runs.key))
            key, context, doc, first = runs.key[order], runs.context[order], doc[order], first[order]
            n = (runs.last - runs.first + 1)[order]
            again = np.zeros(len(order), bool)
            again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & ((doc[1:] != doc[:-1]) | (first[1:] != first[:-1]))
            yield record("key context doc first n", key.view(np.int64), context.view(np.int64), doc, first, np.where(again, -n, n))

    return docs.mapInArrow(emit, "key long, context long, doc long, first long, n long")


def judged_runs(runs: DataFrame) -> DataFrame:
    """doc, place, key: runs whose context is earlier (no key), and the first of each of several contexts with one anchor, with
    the anchor's key where the anchor's contexts reach a power of FAN times BLOCK. place is first * PLACES + n.

    Read as a stream sorted by key, context, doc and place; two rows are held, however many a key has.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, context, doc and first of the context's first row, and the number of the context in its key
        alone = None  # the first row of the key while it has one context
        for b in batches:
            key, context, doc, first, n = (b.column(i).to_numpy() for i in range(5))
            told = n < 0
            if told.any():
                yield judged(doc[told], first[told], -n[told], 0)
                key, context, doc, first, n = (x[~told] for x in (key, context, doc, first, n))
            if not len(key):
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= context[1:] != context[:-1]
            if last is not None:
                new_key[0] = key[0] != last[0]
                new[0] = new_key[0] or context[0] != last[1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            doc0, first0 = np.where(begin < 0, last[2] if last else 0, doc[begin]), np.where(begin < 0, last[3] if last else 0, first[begin])
            again = ~new & ((doc != doc0) | (first != first0))
            if again.any():
                yield judged(doc[again], first[again], n[again], 0)
            contexts = np.flatnonzero(new)
            if not len(contexts):
                continue
            opens = new_key[contexts]
            number = np.arange(len(contexts))
            number = number - np.maximum.accumulate(np.where(opens, number, 0)) + np.where(np.cumsum(opens) == 0, last[4] + 1 if last else 0, 0)
            several = np.concatenate([~opens[1:], [False]])
            if alone is not None and not opens[0]:
                yield judged(*(np.array([x]) for x in alone[:3]), 1, np.array([alone[3]]), np.array([0]))
            alone = None
            kept = contexts[~opens | several]
            if len(kept):
                yield judged(doc[kept], first[kept], n[kept], 1, key[kept], number[~opens | several])
            c = contexts[-1]
            last = (key[c], context[c], doc[c], first[c], int(number[-1]))
            if opens[-1]:
                alone = (doc[c], first[c], n[c], key[c])

    def judged(doc: np.ndarray, first: np.ndarray, n: np.ndarray, kind: int, key: np.ndarray | None = None, number: np.ndarray | None = None) -> pa.RecordBatch:
        level = np.zeros(len(doc), np.int32) - 1 if kind == 0 else sum((number == BLOCK * FAN**i) * (i + 1) for i in range(LEVELS)).astype(np.int32)
        return record("doc place level key", doc, first * PLACES + n, level, pa.array(np.zeros(len(doc), np.int64) if key is None else key, mask=level <= 0))

    dealt = runs.repartition(F.when(F.col("n") < 0, F.xxhash64("doc", "first")).otherwise(F.col("key")))
    return dealt.sortWithinPartitions("key", "context", "doc", "first").mapInArrow(stream, "doc long, place long, level int, key long")


def cut_contexts(docs: DataFrame, wanted: Members | None, crowded: list[Members]) -> DataFrame:
    """group, block, parts, h, string, doc, first of the wanted runs, cut at HALF bytes left of the anchor.

    Without a filter the documents carry ``wanted``, the first starts of their wanted runs. Contexts of an anchor that
    ``crowded[i]`` holds are dealt over FAN ** (i + 1) blocks by their string.
    """
    shared = docs.sparkSession.sparkContext.broadcast((wanted, crowded))

    def hits(rows: pa.RecordBatch, runs: Runs, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        wanted = shared.value[0]
        if wanted is not None:
            return np.flatnonzero(wanted(run_mark(doc, first)))
        lists = rows.column(rows.schema.get_field_index("wanted"))
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        asked = set(zip(row.tolist(), lists.flatten().to_numpy().tolist(), strict=True))
        return np.array([i for i, k in enumerate(zip(runs.row.tolist(), first.tolist(), strict=True)) if k in asked], np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = shared.value[1]
        for rows, raw, at in pieces(batches):
            runs = Runs(raw, at)
            doc = doc_ids(rows)[runs.row]
            hit = hits(rows, runs, doc, runs.first - at[runs.row])
            doc, base, p, a, b, key = doc[hit], at[runs.row[hit]], runs.place[hit], runs.first[hit], runs.last[hit], runs.key[hit]
            parts = np.ones(len(hit), np.int64)
            for i, level in enumerate(crowded):
                parts[level(key)] = FAN ** (i + 1)
            left, right = a <= p - HALF, b > p - HALF
            starts = np.concatenate([a[left], np.maximum(a, p - HALF + 1)[right]])
            ends = np.concatenate([np.minimum(b, p - HALF)[left], b[right]]) + SPAN
            parts = np.concatenate([parts[left], parts[right]])
            group = np.concatenate([runs.hashes((p - HALF)[left], (p + GRAM)[left]), ~runs.hashes(p[right], (p + GRAM + HALF - 1)[right])])
            h = runs.hashes(starts, ends)
            yield record(
                "group block parts h string doc first", group.view(np.int64), (h % parts.astype(np.uint64)).astype(np.int32), parts, h.view(np.int64),
                pa.array([raw[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), np.concatenate([doc[left], doc[right]]), starts - np.concatenate([base[left], base[right]]),
            )

    return docs.mapInArrow(emit, "group long, block int, parts long, h long, string binary, doc long, first long")


def array_spans(contexts: DataFrame) -> DataFrame:
    """doc, first, n, d1, d2 from the suffix arrays over the cut contexts.

    Spans of n starts are removed, but those with a digest (d1, d2), which are the earliest of their block. Equal strings of a
    block are one string of its array; later ones are removed whole. Blocks of one group with one string need no array.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # strings of whole blocks, then of the open block
        whole, size, last = 0, 0, None
        for b in batches:
            again: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:2] != last:
                    if len(held) - whole == 1 and held[-1][2] == 1:
                        held.pop()
                    whole, last = len(held), row[:2]
                    if size >= ARRAY_BYTES:
                        if held:
                            yield spans(held)
                        held, whole, size = [], 0, 0
                elif row[3] == held[-1][3]:
                    if row[5:] != held[-1][5:]:
                        again.append((row[5], row[6], len(row[4]) - SPAN + 1))
                    continue
                held.append(row)
                size += len(row[4])
            if again:
                yield record("doc first n d1 d2", *(np.array(c) for c in zip(*again, strict=True)), *(pa.nulls(len(again), pa.int64()) for _ in range(2)))
        if len(held) - whole == 1 and held[-1][2] == 1:
            held.pop()
        if held:
            yield spans(held)

    def spans(held: list[tuple]) -> pa.RecordBatch:
        owner, start, string = repeated_strings([h[4] for h in held])
        doc = np.array([h[5] for h in held])[owner]
        place = np.array([h[6] for h in held])[owner] + start
        split = np.array([h[2] > 1 for h in held])[owner]
        order = np.lexsort((place, doc, string))
        owner, start, string, doc, place, split = (x[order] for x in (owner, start, string, doc, place, split))
        first = np.ones(len(order), bool)
        first[1:] = string[1:] != string[:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        again = ~first & ((doc != doc[begin]) | (place != place[begin]))
        u = np.lexsort((place[again], doc[again]))
        d, p = doc[again][u], place[again][u]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
        k = np.flatnonzero(new)
        n = (p[np.concatenate([k[1:], [len(p)]]) - 1] - p[k] + 1) if len(k) else p
        win = np.flatnonzero(first & split)
        digests = [hashlib.blake2b(held[o][4][s : s + SPAN], digest_size=16).digest() for o, s in zip(owner[win].tolist(), start[win].tolist(), strict=True)]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        none = [None] * len(k)
        return record(
            "doc first n d1 d2", np.concatenate([d[k], doc[win]]).astype(np.int64), np.concatenate([p[k], place[win]]).astype(np.int64), np.concatenate([n, np.ones(len(win))]).astype(np.int64),
            pa.array(none + halves[:, 0].tolist(), pa.int64()), pa.array(none + halves[:, 1].tolist(), pa.int64()),
        )

    dealt = contexts.repartition("group", "block").sortWithinPartitions("group", "block", "h", "doc", "first")
    return dealt.mapInArrow(build, "doc long, first long, n long, d1 long, d2 long")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc, first, n: the strings of SPAN bytes at first..first+n-1 also start earlier."""
    runs = cut(judged_runs(all_runs(docs)))
    firsts = runs.filter("level >= 0")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record("mark", run_mark(b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy() // PLACES))

    counts = {r["level"]: r["n"] for r in firsts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    wanted = None
    if sum(counts.values()) <= FILTERED:
        wanted = members(firsts.select("doc", "place").mapInArrow(mark, "mark long"), "mark", sum(counts.values()))
    else:
        places = firsts.groupBy("doc").agg(F.collect_list(F.floor(F.col("place") / PLACES).cast("long")).alias("wanted"))  # the runs of one document
        docs = docs.join(places, F.coalesce("doc_id", F.lit(LAST)) == F.col("doc")).select("doc_id", "text", "wanted")
    crowded = [members(firsts.filter(F.col("level") == i), "key", counts[i]) for i in range(1, max(counts, default=0) + 1)]
    spans = cut(array_spans(cut_contexts(docs, wanted, crowded)))
    rivals = spans.filter("d1 is not null")
    best = rivals.groupBy("d1", "d2").agg(F.min(F.struct("doc", "first")).alias("best"))
    beaten = rivals.join(best, ["d1", "d2"]).filter(F.struct("doc", "first") > F.col("best")).select("doc", "first", "n")
    whole = runs.filter("level < 0").select("doc", F.shiftright("place", 7).alias("first"), (F.col("place") % PLACES).alias("n"))
    return whole.unionAll(spans.filter("d1 is null").select("doc", "first", "n")).unionAll(beaten)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Defined cases: a null text is empty; texts under SPAN bytes keep all; a null doc_id counts as the last document; rows that share a
    doc_id count as one document, so a string at one place in both isn't earlier, and what is removed is removed from each;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    spans = removed_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    spans = cut(spans)
    many = spans.count()
    touched = docs.sparkSession.sparkContext.broadcast(members(spans, "doc", many)) if many <= FILTERED else None
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = "doc_id n_bytes n_removed n_spans kept_sha256"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.filter(pa.array(~touched.value(doc_ids(b))))
            raw, at = text_bytes(rows.column(1))
            zero = np.zeros(rows.num_rows, np.int64)
            yield record(names, rows.column(0), np.diff(at), zero, zero, pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(touched.value(doc_ids(b))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches):
            out = []
            for i, found in enumerate(rows.column(2).to_pylist()):
                text = raw[at[i] : at[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                for s in found or ():
                    if s["first"] < len(text):
                        edge[s["first"]] += 1
                        edge[min(len(text), s["first"] + s["n"] + SPAN - 1)] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield record(names, rows.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True)))

    if touched is None:
        joined = docs.join(spans, F.coalesce("doc_id", F.lit(LAST)) == F.col("doc"), "left").select("doc_id", "text", "spans")
        return joined.mapInArrow(clean, result)
    untouched = docs.mapInArrow(whole, result)
    texts = docs.mapInArrow(hit, docs.schema)
    joined = texts.join(spans, F.coalesce("doc_id", F.lit(LAST)) == F.col("doc"), "left").select("doc_id", "text", "spans")
    return untouched.unionAll(joined.mapInArrow(clean, result))
