"""What the operators share: tables, the shared folder, bounded filters, and words of Arrow text as NumPy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from bagweave.functions.lineage import cut, ensure_shared_dir

__all__ = ["cut"]

#: White space of the word pattern `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that is worked on at once in a Python worker, in bytes; a longer text is worked on alone.
PIECE_BYTES = 1 << 20
#: Rows that are worked on at once, however short.
PIECE_ROWS = 1 << 16
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_dir(path: str) -> None:
    """Removes a folder that fresh_dir named, if it was made."""
    store, folder = pafs.FileSystem.from_uri(path)
    if store.get_file_info(folder).type == pafs.FileType.Directory:
        store.delete_dir(folder)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the frame's columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in have:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- scans of array columns ----------------------------------------------------------------

#: Elements of an array that are scanned in a row.
SCAN_BLOCK = 256


def bound_to(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def scanned(values: Column, step=lambda a, b: a + b) -> Column:
    """Of an array of ints, 0 and what ``step`` makes of 0 and the elements so far: one element more than the array has.

    Elements are scanned in blocks, then the blocks; no array grows by one element at a time beyond a block, so that the work is
    nearly linear in the array's size.
    """
    def run(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, state, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["out"], F.array(step(s["at"], v))).alias("out")))["out"]

    def blocks(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / SCAN_BLOCK).cast("int"))
        parts = F.transform(numbers, lambda b: F.slice(whole, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))

        def joined(parts: Column) -> Column:
            starts = run(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, b: step(a, b))), F.lit(0))
            return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.concat(F.array(F.lit(0)), F.slice(starts, F.lit(1), F.size(parts) - 1)).alias("start")), lambda x: run(x["part"], x["start"])))

        return F.concat(F.array(F.lit(0)), bound_to(parts, joined))

    return bound_to(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array(F.lit(0))))


def cut_out(text: Column, spans: Column) -> Column:
    """The parts of a text that spans (start, end, ordered by start) cover, in an array.

    A place in a text is found by reading up to it, so SCAN_BLOCK spans cut their stretch out first, and their parts out of that.
    """
    def stretch(whole: Column, own: Column) -> Column:
        begin, end = F.get(own, 0)["start"], F.array_max(F.transform(own, lambda s: s["end"]))
        held = F.struct(own.alias("own"), F.substring(whole, begin + 1, end - begin).alias("piece"), begin.alias("begin"))
        return bound_to(held, lambda x: F.transform(x["own"], lambda s: F.substring(x["piece"], s["start"] - x["begin"] + 1, s["end"] - s["start"])))

    def parts(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(x["spans"]) - 1) / SCAN_BLOCK).cast("int"))
        return F.flatten(F.transform(numbers, lambda b: bound_to(F.slice(x["spans"], b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), lambda own: stretch(x["text"], own))))

    return bound_to(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.when(F.size(x["spans"]) > 0, parts(x)).otherwise(F.array().cast("array<string>")))


# --- bounded membership filters ------------------------------------------------------------


#: Bits of a filter: at most 32 MB, whatever the input; beyond that only the rate of false hits grows.
MIN_BITS, MAX_BITS = 16, 28


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a bit map."""
    first = mix(keys.view(np.uint64))
    return first >> np.uint64(64 - bits), mix(first + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Members:
    """A bit map of hashed 64-bit keys: never misses a key, may admit others."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        one, two = ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1 for p in probes(keys, self.bits))
        return one & two


def members(keys: DataFrame, column: str, n: int) -> Members:
    """The filter of a column of longs, with 32 bits for each of n keys within MIN_BITS..MAX_BITS; the driver gets the bit map alone."""
    bits = min(MAX_BITS, max(MIN_BITS, int(n * 32).bit_length()))

    def places(batches):
        for batch in batches:
            place = np.unique(np.concatenate(probes(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "mask"])

    rows = keys.select(column).mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Members(words, bits)


# --- text as bytes --------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (xor, shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = (_rng.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each (null: empty)."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``size`` bytes of text and ``most`` rows: the rows, their bytes, their offsets."""
    for batch in batches:
        raw, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            j = min(j, i + most, batch.num_rows)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def word_spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of each word; ``gaps``: the bytes between words."""
    inside = ~gaps[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(raw) else inside
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(raw) else inside
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash (xxh3) of each of the disjoint, ordered spans of bytes, A-Z in lower case or as they are; equal spans are hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length)])
    data = raw[np.arange(at[-1]) + np.repeat(starts - at[:-1], length)]
    if lower:
        data = LOWER[data]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return np.fromiter(map(xxh3_64_intdigest, spans.dictionary.to_pylist()), np.uint64, len(spans.dictionary))[spans.indices.to_numpy()]


def run_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a row, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - n + 1] * SHINGLE[0]
    for i in range(1, n):
        h = h + words[i : len(words) - n + 1 + i] * SHINGLE[i]
    first = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1 :])
    return mix(h[first]), first


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's sorted distinct hashes of n-word shingles of A-Z-lower-cased words, fewer words making one shingle; and the words of each row."""
    starts, ends, row = word_spans(raw, at)
    words = span_hashes(raw, starts, ends)
    rows = len(at) - 1
    count = np.bincount(row, minlength=rows)
    h, first = run_hashes(words, row, n)
    place = np.searchsorted(row[first], np.arange(rows + 1))
    word_at = np.concatenate([[0], np.cumsum(count)])
    out = []
    for i in range(rows):
        if count[i] >= n:
            s = np.sort(h[place[i] : place[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif count[i]:
            w = words[word_at[i] : word_at[i + 1]]
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(w * SHINGLE[: len(w)]).sum() + np.uint64(len(w)) * np.uint64(0xA24BAED4963EE407)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, count
