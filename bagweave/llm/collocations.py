"""Phrase collocations of each language by growing contiguous patterns to the right.

Two passes read the texts. The first counts adjacent word pairs by a 64-bit key; keys below the least count go, and a bounded bit map
of the rest tells the second pass which pairs can be part of a frequent phrase (it never misses one and may admit others). The second
pass projects the occurrences: each word's pointer is followed to the right as long as pairs may be frequent, four words at most,
and equal projections become one row with a count, in the worker first, then by a shuffle. The rows are sorted and dealt by range, so
a prefix lies in one task with all its projections (one that is too large for a task is cut between two of its longer prefixes, and the
counts of both parts are added up). Inside a task, each frequent prefix is a range of rows that is split by the next word, depth first.

All counts are exact: keys and bit map only spare work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from bagweave.llm.common import LOWER, SHINGLE, cut, members, mix, partitions, pieces, span_hashes, word_spans

#: A phrase is a candidate from this count on, and has two to LONGEST words.
LEAST, LONGEST = 30, 4
#: Phrases that are returned of each language.
TOP = 2000
#: Text that is worked on at once, in bytes, and projections that are grown at once.
TEXT_BYTES, ROWS = 1 << 21, 1 << 16
#: A candidate goes if a longer one that holds it has at least this share of its count, in percent.
COVERED = 80

#: Bytes that end a piece of text, and those between words inside a piece.
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = STOPS.copy()
GAPS[[0x20, 0x09]] = True


def languages(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def short_runs(raw: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes as they are, or those of one long row in parts that end with a piece."""
    if len(at) > 2 or len(raw) <= most:
        yield raw, at
        return
    ends = np.flatnonzero(STOPS[raw]) + 1
    begin = 0
    while begin < len(raw):
        fits = np.searchsorted(ends, begin + most, side="right")
        last = ends[fits - 1] if fits and ends[fits - 1] > begin else ends[fits] if fits < len(ends) else len(raw)
        last = len(raw) if len(raw) - begin <= most else int(last)
        yield raw[begin:last], np.array([0, last - begin])
        begin = last


class Words:
    """The words of some texts: their places, rows and languages, and the keys of the pairs inside a piece."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lang: pa.Array) -> None:
        self.raw = raw
        self.starts, self.ends, row = word_spans(raw, at, GAPS)
        known = lang.dictionary_encode()
        self.langs, self.lang = known.dictionary, known.indices.to_numpy()[row].astype(np.int64)
        stops = np.cumsum(STOPS[raw])
        piece = stops[self.starts] if len(raw) else np.zeros(0, np.int64)
        self.first = np.flatnonzero((piece[1:] == piece[:-1]) & (row[1:] == row[:-1]))
        word = span_hashes(raw, self.starts, self.ends)
        salt = np.array([xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        self.keys = mix(word[self.first] * SHINGLE[0] + word[self.first + 1] * SHINGLE[1] + salt[self.lang[self.first]]).view(np.int64)

    def projections(self, frequent) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, words (each with a space behind it) and count of each distinct projection."""
        n = len(self.starts)
        goes = np.zeros(n + LONGEST, np.int64)
        goes[self.first[frequent(self.keys)]] = 1
        words = np.ones(n, np.int64)
        on = np.ones(n, np.int64)
        for i in range(LONGEST - 1):
            on = on * goes[i : n + i]
            words += on
        size = self.ends - self.starts
        head = np.concatenate([[0], np.cumsum(size)])
        plain = np.full(head[-1] + n, 0x20, np.uint8)
        index = np.arange(head[-1])
        plain[index + np.repeat(np.arange(n), size)] = LOWER[self.raw[index + np.repeat(self.starts - head[:-1], size)]]
        place = head + np.arange(n + 1)
        begin, length = place[:-1], place[np.arange(n) + words] - place[:-1]
        to = np.concatenate([[0], np.cumsum(length)])
        data = plain[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
        runs = pa.LargeStringArray.from_buffers(n, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        langs = max(1, len(self.langs))
        code, count = np.unique(runs.indices.to_numpy().astype(np.int64) * langs + self.lang, return_counts=True)
        return self.langs.take(pa.array(code % langs)), runs.dictionary.take(pa.array(code // langs)), count


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for rows, raw, at in pieces(batches, size=TEXT_BYTES):
        lang = rows.column(rows.schema.get_field_index("lang"))
        for part, place in short_runs(raw, at, TEXT_BYTES):
            words = Words(part, place, lang)
            if len(words.starts):
                yield words


def frequent_pairs(docs: DataFrame, least: int) -> DataFrame:
    """The keys of pairs with the least count."""

    def counted(batches):
        for words in parted(batches):
            key, n = np.unique(words.keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return docs.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def grown(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases that grow out of sorted projections, with counts; a phrase at an edge of the rows at hand is given whatever its count. An empty phrase has the count of all words."""
    held: list[pa.RecordBatch] = []

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        lang, run = (rows.column(c).combine_chunks().cast(pa.large_string()) for c in ("lang", "run"))
        total = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())])
        return phrases(lang, run, total, least)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield flush()
    if any(b.num_rows for b in held):
        yield flush()


def phrases(lang: pa.Array, run: pa.Array, total: np.ndarray, least: int) -> pa.RecordBatch:
    n = len(run)
    at = np.frombuffer(run.buffers()[1], np.int64)[run.offset : run.offset + n + 1]
    data = np.frombuffer(run.buffers()[2], np.uint8)
    code = lang.dictionary_encode().indices.to_numpy()
    size = np.diff(at)
    # bytes that a row has in common with the row before, none if their languages differ
    row = np.repeat(np.arange(n), size)
    place = np.arange(at[0], at[-1])
    inside = place - at[row]
    before = at[np.maximum(row - 1, 0)] + inside
    other = (inside >= size[np.maximum(row - 1, 0)]) | (data[place] != data[np.minimum(before, at[-1] - 1)])
    common = np.minimum.reduceat(np.where(other, inside, np.int64(1) << 40), at[:-1] - at[0])
    common = np.where(np.concatenate([[False], code[1:] == code[:-1]]), common, 0)
    # bytes of the first 1, 2, .. words of each row (a space ends each word); none where it has fewer
    space = np.flatnonzero(data[at[0] : at[-1]] == 0x20)
    of = row[space]
    nth = np.arange(len(space)) - np.searchsorted(of, np.arange(n))[of]
    width = np.zeros((LONGEST + 1, n), np.int64)
    width[nth + 1, of] = inside[space] + 1
    opens = [np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])] + [np.flatnonzero(common < w) for w in width[1:]]
    found: list[tuple[int, int, int]] = []

    def grow(lo: int, hi: int, depth: int) -> None:
        """Rows lo to hi share their first words, ``depth`` of them; the rows of each longer prefix are a range among them."""
        count = int(total[hi] - total[lo])
        if depth and count < least and lo and hi < n:
            return
        found.append((lo, depth, count))
        if depth == LONGEST:
            return
        starts = opens[depth + 1]
        starts = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
        if len(starts):
            ends = np.append(starts[1:], hi)
            if not depth:  # most single words are too rare: leave them out at once
                wanted = (total[ends] - total[starts] >= least) | (starts == 0) | (ends == n)
                starts, ends = starts[wanted], ends[wanted]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                grow(a, b, depth + 1)

    bounds = np.append(opens[0], n).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        grow(lo, hi, 0)
    first, depth, count = (np.array(x, np.int64) for x in zip(*found, strict=True))
    begin, length = at[first], np.maximum(width[depth, first] - 1, 0)
    to = np.concatenate([[0], np.cumsum(length)])
    text = data[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
    phrase = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(text.copy()))
    return pa.RecordBatch.from_arrays([lang.take(pa.array(first)).cast(pa.string()), phrase.cast(pa.string()), pa.array(count)], ["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f: every phrase of one to four words with the least count, and an empty phrase with the count of all words of each language."""
    texts = languages(docs)
    keys = cut(frequent_pairs(texts, least))
    frequent = members(keys, "key", keys.count())

    def projected(batches):
        for words in parted(batches):
            lang, run, n = words.projections(frequent)
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), run.cast(pa.string()), pa.array(n)], ["lang", "run", "n"])

    runs = texts.mapInArrow(projected, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    dealt = runs.repartitionByRange(partitions(docs.sparkSession), "lang", "run").sortWithinPartitions("lang", "run")
    found = dealt.mapInArrow(lambda batches: grown(batches, least), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate: its lowest-scoring cut, the leftmost of equals.

    2,000,000 a / (l + r) is taken of decimals, whose products pass 64 bits unharmed.
    """
    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    cuts = counts.filter(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.size(words))})
    left, right = (counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)) for key, name in (("first", "l"), ("rest", "r")))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000BD div (cast(l as decimal(20, 0)) + r)")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate in which the phrase lies."""
    words = F.split("phrase", " ")
    longer = counts.filter(F.size(words) > 2).select("lang", "f", words.alias("w"), F.explode(F.sequence(F.lit(2), F.size(words) - 1)).alias("n"))
    longer = longer.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("k"))
    return longer.select("lang", F.array_join(F.slice("w", F.col("k"), F.col("n")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Defined cases: a null text is empty, a null lang is ``und`` (so is the lang of that name); repeated rows count as often as they
    are there; ties in score go by count, then by the phrase's bytes; a language without candidates and an empty table
    give no rows; other columns are ignored. A long text is read in parts that end at punctuation or a line's end.
    """
    counts = cut(phrase_counts(docs, least))
    words = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    open_ = scored(counts.filter("phrase <> ''")).join(covered(counts), ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * COVERED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
