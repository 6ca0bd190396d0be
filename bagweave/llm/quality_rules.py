"""Quality rules: fixed base rules, and cutoffs whose false rejection is bounded on labelled holdouts.

Each document gets counts of words, symbols, repeated lines and repeated 8-word windows, and from them
rates of which more is worse. Labelled good documents are dealt by a hash into a proposal half and a holdout
half. In each stratum (a language) the proposal half gives, for each level of a fixed sequence from
lenient to strict, one cutoff per rate (a quantile). The holdout half tests the joint verdict of each
level: a level passes if the exact binomial chance of at most the observed number of rejected good
documents, were the true rate ALPHA, is no more than DELTA / number of strata. The levels are tested in order
up to the first that fails (fixed-sequence testing), so with Bonferroni over strata all
chosen cutoffs hold together with confidence 1 - DELTA. A stratum without a passed level rejects nothing by method.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagweave.functions.ranged import ranged_sums
from bagweave.llm.common import cut, pieces, run_hashes, span_hashes, word_spans

#: Fixed values of the contract: symbols, window, base rules.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The bound on false rejection in a stratum, the chance that any bound fails, and the levels, lenient first (share of good proposal documents beyond a cutoff).
ALPHA, DELTA = 0.05, 0.05
#: Strata whose cutoffs are broadcast (some 100 bytes each); more are joined.
FEW_STRATA = 10_000
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05)
RATES = ("symbol_rate", "line_rate", "repeat_rate", "upper_rate")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def per_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[at[1:]] - sums[at[:-1]]


def repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key): whether it is found again in its row, and whether it was found before (in order)."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    both = later.copy()
    both[order[:-1]] |= same
    return both, later


def text_stats(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    rows = len(at) - 1
    starts, ends, row = word_spans(raw, at)
    n_words = np.bincount(row, minlength=rows)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1]) > 0 if len(raw) else np.zeros(0, bool)
    words = span_hashes(raw, starts, ends, lower=False)
    windows, first = run_hashes(words, row, WINDOW)
    both, _ = repeated(windows, row[first])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first[both], 1)
    np.add.at(cover, first[both] + WINDOW, -1)
    n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    breaks = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    line_row = np.searchsorted(at, line_start, side="right") - 1
    line_end = np.minimum(np.concatenate([line_start[1:], [len(raw)]]), at[line_row + 1]) if len(line_start) else line_start
    line_end = line_end - (raw[line_end - 1] == 10) if len(line_start) else line_end
    word_sums = np.concatenate([[0], np.cumsum(in_word)])
    full = word_sums[line_end] > word_sums[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    lines = span_hashes(raw, line_start, line_end, lower=False)
    _, later = repeated(lines, line_row)
    return [
        n_words, per_row(in_word & _FIRST[raw], at), per_row(_IS_SYMBOL[raw], at), np.bincount(line_row[later], minlength=rows),
        n_repeat, np.bincount(line_row, minlength=rows), per_row(_UPPER[raw], at),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document (null text: none)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches):
            stats = text_stats(raw, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(s.astype(np.int64)) for s in stats)], ["doc_id", "lang", *(x.split()[0] for x in STATS.split(", "))])

    return docs.select("doc_id", "lang", "text").mapInArrow(measure, "doc_id long, lang string, " + STATS)


def rates() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_rate": per("n_symbols", "n_words"), "line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars")}


def tail(k: int, n: int, p: float) -> float:
    """The exact chance of at most k of n at rate p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs))


def cutoffs_by_level(rows: DataFrame) -> DataFrame:
    """stratum and, for each rate, an array of its exact upper quantiles at LEVELS: of n values in order, that at place ceil((1 - level) n).

    Equal rates are counted once, and places are running sums over ranges of (language, rate, value), so a large language is no hot key.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("rate"), F.col(r).alias("value")) for i, r in enumerate(RATES))))
    counts = rows.select("lang", pairs.alias("p")).groupBy("lang", "p.rate", "p.value").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(ranged_sums(counts, [F.col("lang"), F.col("rate"), F.col("value")], {"upto": F.col("n")}))
    groups = placed.groupBy("lang", "rate").agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("base"))
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("level")) for i, x in enumerate(LEVELS))))
    wanted = groups.withColumn("l", levels).select("lang", "rate", "l.i", (F.col("base") + F.greatest(F.lit(1.0), F.ceil((1 - F.col("l.level")) * F.col("all"))).cast("long")).alias("place"))
    found = placed.join(wanted, ["lang", "rate"]).filter((F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n")))
    at = lambda i, r: F.max(F.when((F.col("i") == i) & (F.col("rate") == r), F.col("value")))
    return found.groupBy(F.col("lang").alias("stratum")).agg(*(F.array(*(at(i, r) for i in range(len(LEVELS)))).alias(f"cut_{name}") for r, name in enumerate(RATES)))


def chosen_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and the cutoff of each rate, for the strata with a passed level. Equal rows of one document are one trial."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("good_id"))
    rows = stats.join(good, F.col("doc_id") == F.col("good_id")).dropDuplicates()
    rows = rows.withColumns(rates()).withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("half", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long") % 2)
    proposed = cut(cutoffs_by_level(rows.filter("half = 0")))
    tested = rows.filter("half = 1").join(F.broadcast(proposed) if proposed.count() <= FEW_STRATA else proposed, F.col("lang") == F.col("stratum"))
    fails = [F.count_if(F.greatest(*(F.col(r) > F.col(f"cut_{r}")[i] for r in RATES))).alias(f"k{i}") for i in range(len(LEVELS))]
    summary = cut(tested.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), *fails, *(F.first(f"cut_{r}").alias(f"cut_{r}") for r in RATES)))
    strata = summary.count()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.to_pylist():
                passed = None
                for i in range(len(LEVELS)):
                    if tail(s[f"k{i}"], s["n"], alpha) > delta / strata:
                        break
                    passed = i
                if passed is not None:
                    out.append((s["stratum"], *(float(s[f"cut_{r}"][passed]) for r in RATES)))
            columns = list(zip(*out, strict=True)) or [[]] * (1 + len(RATES))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.float64()] * len(RATES), strict=True)], ["stratum", *(f"limit_{r}" for r in RATES)])

    return cut(summary.mapInArrow(test, "stratum string, " + ", ".join(f"limit_{r} double" for r in RATES)))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    Defined cases: a null text has no words and fails the base rules; a null language is the stratum "" (as is
    the empty one); documents whose labels disagree count as not good; without labels only the base rules reject;
    repeated rows are each judged; an empty table gives an empty result; other columns are ignored.
    """
    stats = cut(measured(docs))
    cutoffs = chosen_cutoffs(stats, labels, alpha, delta)
    cutoffs = F.broadcast(cutoffs) if cutoffs.count() <= FEW_STRATA else cutoffs
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rate = rates()
    beyond = F.coalesce(F.greatest(*(rate[r] > F.col(f"limit_{r}") for r in RATES)), F.lit(False))
    rows = stats.join(cutoffs, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~beyond).drop("stratum", *(f"limit_{r}" for r in RATES))
