"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut at each source's budget.

Every document gets a hash-random key. Within a source the keys are split into fixed ranges (a
range sort: the range number is the key's leading bits), the word sums of the ranges are added up
in key order, and inside a range a window adds the documents' own words. So a hot source is dealt
over all ranges and no task sees more than one range. A source takes whole epochs first and then
the documents before its cut; the one at the cut gives only the words that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagweave.llm.common import WORD, free_names

#: Ranges of keys in each source.
RANGES = 4096
#: A source is taken this many times at most.
MAX_EPOCHS = 3


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. With all caps at MAX_EPOCHS
    times the size, sharing the excess again until none is above ends at one common level L:
    a source gets min(cap, weight * L). Sources sorted by cap / weight fill their caps from the
    first on, so L is the first (total - caps before) / (weights from here) within its own source's cap.
    The rows are one per source; the windows below see nothing else.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(MAX_EPOCHS)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    best = F.max(F.when(F.col("fits"), F.col("level"))).over(every)  # past the first that fits, levels only fall
    return levels.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(best, F.lit(0.0)))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, key.

    Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its
    own; repeated rows each count, as do rows without a doc_id (their texts spread them over the ranges; ties of the key fall to
    doc_id, then size, which leaves the same multiset of results); an empty table gives an empty result; other columns are ignored.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select("doc_id", "source", size_of().alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key")).withColumn("range", F.shiftrightunsigned("key", 60 - (RANGES - 1).bit_length()).cast("int"))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("base", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).select("source", "range", "base").withColumnRenamed("source", "s1").withColumnRenamed("range", "r1")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("s1")) & (F.col("range") == F.col("r1"))).drop("s1", "r1")
    totals = totals.withColumnRenamed("source", "s2")
    budget = F.round("target").cast("long")
    rows = placed.join(totals, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    epochs = F.floor(F.coalesce(F.try_divide(budget, F.col("source_size")), F.lit(0.0)))
    left = budget - epochs * F.col("source_size") - F.col("base") - F.col("own")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``taken``, the words it takes of each, repeats counted.

    A document of 10 words with taken 23 is read twice and then for its first 3 words; its text is kept whole here.
    Each row has its own share: rows without a doc_id stay, and of rows with one doc_id, source and size each gets one of their shares.
    If the documents have a column ``taken``, it stays and the new one is ``_taken``.
    """
    key, nth, taken = free_names(docs, "mix_key", "mix_nth", "taken")
    row = lambda size: F.to_json(F.struct("doc_id", "source", size.alias("size")))  # noqa: E731 - leaves out nulls
    number = lambda order: F.row_number().over(Window.partitionBy(key).orderBy(order))
    shares = mix_sources(docs, seed).select(row(F.col("size")).alias(key), F.col("taken").alias(taken)).withColumn(nth, number(F.desc(taken))).filter(F.col(taken) > 0)
    rows = docs.withColumn(key, row(size_of())).withColumn(nth, number(F.xxhash64("text")))
    return rows.join(shares, [key, nth]).drop(key, nth)
