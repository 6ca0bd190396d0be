"""Secret scans with Spark expressions only.

Base patterns are matched leftmost and non-overlapping; a text is split at the matches of a
pattern, so the lengths of gaps and matches give every position in code points. Beside them,
candidate strings (long runs of the alphabet of keys) are read with a sliding window: of the characters in it a packed
counter of five bits each is kept; each step takes one character out and one in, and the sum of c*log2(c) changes by
these two alone, which gives the Shannon entropy of each window in constant time. Long candidates are read in pieces
that overlap by a window, so that memory doesn't grow with them. A candidate of a character class whose
best window reaches that class's bound is a span too, unless an allow-list pattern covers it. Base spans are
cut out of a candidate first, and each remainder of a window or more is read by itself; windows that hold
an allowed literal don't count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagweave.llm.common import bound_to, cut_out, free_names, scanned

#: Fixed values of the contract: patterns and least lengths.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates: runs of the alphabet of keys with a digit and a letter; window, and bits of entropy a window must reach, by class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = {"hexdigits": ("^[0-9a-fA-F]+$", 3.0), "alnum": ("^[A-Za-z0-9]+$", 3.7), "base64": ("^[A-Za-z0-9+/=_-]+$", 3.9)}
#: Not secrets: identifiers in groups, dates and numbers, words.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
)
#: Nor paths of words: what is left when their parts go is empty, or a slash in front.
PART = r"[A-Za-z]+[0-9]{0,4}(?:[/_-]|$)|(?<=[/_-])[0-9]{1,4}$"
#: Marks of samples: a window with one of them is no secret, what stands beside it may be.
LITERALS = ("EXAMPLE", "example", "xxxxx", "XXXXX", "00000", "12345")
#: Characters whose counts one long holds, five bits each (a window holds 20 at most), and the alphabet, by place.
PACKED = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a candidate that are read at once; matches whose positions are added up at once.
PIECE, BLOCK = 4096, 256
SPANS = "array<struct<start:int,end:int,value:string>>"
KINDS = ("assign", "access", "hex", "entropy")


def appended(found: Column, start: Column, end: Column, value: Column) -> Column:
    return F.concat(found, F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"))))


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, value) of the pattern's matches, value being the group.

    Lengths are added up in blocks of matches, then over the blocks, so that a text of very many matches isn't copied for each.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast(SPANS)

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(m["gap"])
        end = begin + F.length(m["whole"])
        return F.struct(end.alias("at"), appended(state["found"], begin, end, m["value"]).alias("found"))

    def join(state: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda m: F.struct((m["start"] + state["at"]).alias("start"), (m["end"] + state["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["found"], F.array(moved)).alias("found"))

    def blocks(matches: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        parts = F.transform(numbers, lambda b: F.aggregate(F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("found")), step))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found"))
        return F.flatten(F.aggregate(parts, start, join, lambda s: s["found"]))

    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value")), lambda m: m["whole"].isNotNull())
    return F.when(F.size(whole) > 0, bound_to(zipped, blocks)).otherwise(none)


def remainders(runs: Column, spans: Column) -> Column:
    """Array of (start, end, value): what the spans leave of the runs, in parts of WINDOW characters or more.

    Runs and spans are sorted into one array; of each place in it, the end of what spans before it cover and the number of runs before
    it come from scans, so a part is judged by its place alone.
    """

    def tagged(rows: Column, kind: int) -> Column:
        return F.transform(rows, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def parts(x: Column) -> Column:
        """A part ends where the next run or span starts, or where its run ends."""
        def part(e: Column, i: Column) -> Column:
            run = F.get(x["runs"], F.get(x["opened"], i) - 1)
            begin, stop = F.greatest(F.get(x["covered"], i), run["start"]), F.least(e["start"], run["end"])
            return F.struct(begin.alias("start"), stop.alias("end"), F.when(stop - begin >= WINDOW, F.substring(run["value"], begin - run["start"] + 1, stop - begin)).alias("value"))

        last = F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end")))
        return F.filter(F.transform(F.concat(x["events"], last), part), lambda m: m["value"].isNotNull())

    def swept(x: Column) -> Column:
        ends = F.transform(x["events"], lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(0))
        return bound_to(F.struct(x["events"].alias("events"), x["runs"].alias("runs"), scanned(ends, F.greatest).alias("covered"), scanned(F.transform(x["events"], lambda e: e["kind"])).alias("opened")), parts)

    events = lambda r: F.struct(r.alias("runs"), F.array_sort(F.concat(tagged(spans, 0), tagged(r, 1))).alias("events"))
    return bound_to(bound_to(runs, events), lambda x: F.when(F.size(x["runs"]) > 0, swept(x)).otherwise(F.array().cast(SPANS)))


def window_entropy(value: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of WINDOW characters of ALPHABET that holds none of LITERALS, by incremental counts."""
    pieces = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    both = bound_to(pieces, lambda p: F.arrays_zip(p.alias("own"), F.concat(F.array(F.lit("")), p).alias("before")))
    whole = F.transform(F.filter(both, lambda x: x["own"].isNotNull()), lambda x: F.concat(F.right(x["before"], F.lit(WINDOW - 1)), x["own"]))
    return F.coalesce(F.array_max(F.transform(whole, piece_entropy)), F.lit(0.0))


def piece_entropy(value: Column) -> Column:
    codes = F.array(*(F.lit(ALPHABET.find(chr(c)) if chr(c) in ALPHABET else len(ALPHABET)) for c in range(128)))
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    longs = range(len(ALPHABET) // PACKED + 1)

    def events(chars: Column) -> Column:
        """A character out, if the window is full, and one in, for each."""
        zipped = F.arrays_zip(chars.alias("c"), F.concat(F.array_repeat(F.lit(""), WINDOW), chars).alias("out"))
        event = lambda c, by: F.struct(F.get(codes, F.ascii(c)).alias("code"), F.lit(by).alias("by"), c.alias("c"))
        return F.flatten(F.transform(F.filter(zipped, lambda x: x["c"].isNotNull()), lambda x: F.when(x["out"] == "", F.array(event(x["c"], 1))).otherwise(F.array(event(x["out"], -1), event(x["c"], 1)))))

    def step(state: Column, e: Column) -> Column:
        word, place = F.floor(e["code"] / PACKED).cast("int"), (e["code"] % PACKED * 5).cast("int")
        counts = F.get(F.array(*(state[f"w{k}"] for k in longs)), word)
        count = F.call_function("shiftright", counts, place).bitwiseAND(F.lit(31)).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), place) * e["by"]
        total = state["total"] + F.get(terms, count + e["by"]) - F.get(terms, count)
        came = e["by"] == 1
        at = state["at"] + F.when(came, 1).otherwise(0)
        tail = F.when(came, F.right(F.concat(state["tail"], e["c"]), F.lit(max(map(len, LITERALS))))).otherwise(state["tail"])
        mark = F.when(came, F.coalesce(*(F.when(tail.endswith(x), at - len(x)) for x in LITERALS), state["mark"])).otherwise(state["mark"])
        entropy = F.when(came & (at >= WINDOW) & (mark < at - WINDOW), F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(0.0)
        return F.struct(
            *((state[f"w{k}"] + F.when(word == k, one).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in longs),
            total.alias("total"), F.greatest(state["best"], entropy).alias("best"), at.alias("at"), tail.alias("tail"), mark.alias("mark"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(*(zero.alias(f"w{k}") for k in longs), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(-WINDOW - 1).alias("mark"))
    return F.aggregate(bound_to(F.split(value, ""), events), start, step, lambda s: s["best"])


def scan_secrets(docs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Adds assign, access, hex and entropy, arrays of (start, end, value), to the documents (columns doc_id and text are read).

    Base matches are those of the patterns: assign keeps values of 6 characters and more. entropy holds further
    spans that no base span overlaps. Defined cases: a null text is empty and has no spans; repeated rows
    are each scanned; an empty table gives an empty result; extra columns stay, and where one has a name of the four, the
    scan's has underscores in front.
    """
    assign, access, hexes, entropy = names or free_names(docs, *KINDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({assign: F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6), access: located(text, ACCESS), hexes: located(text, HEX)})
    free = remainders(located(text, CANDIDATE), F.concat(assign, access, hexes))
    path = lambda v: v.rlike("[/_-]") & F.regexp_replace(v, PART, "").isin("", "/")
    free = F.filter(free, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike("|".join(ALLOW)) & ~path(m["value"]))
    bound = lambda v: F.coalesce(*(F.when(v.rlike(p), F.lit(b)) for p, b in CLASSES.values()))
    found = found.withColumn(entropy, free)
    return found.withColumn(entropy, F.when(F.size(entropy) > 0, F.filter(entropy, lambda m: window_entropy(m["value"]) >= bound(m["value"]))).otherwise(F.col(entropy)))


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.concat(*(ranked(i, k) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(span_list(KINDS[:3]), 256).alias("base_sha256"), span_list(KINDS).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by the mark; spans that overlap become one. n_chars, if present, is counted anew. Other columns stay as they are."""
    names = free_names(docs, *KINDS)
    spans = F.array_sort(F.concat(*(F.transform(F.col(k), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in names)))
    text = F.coalesce(F.col("text"), F.lit(""))

    def marked(x: Column) -> Column:
        """What lies between the spans that begin a mark and the ends of what the spans before them cover, a mark behind each; then the rest."""
        gaps = F.filter(F.transform(x["spans"], lambda s, i: F.struct(F.get(x["covered"], i).alias("start"), s["start"].alias("end"))), lambda s: s["end"] >= s["start"])
        return F.concat(F.array_join(F.transform(cut_out(text, gaps), lambda t: F.concat(t, F.lit(mark))), ""), F.substring(text, F.element_at(x["covered"], -1) + 1, 2147483647))

    clean = bound_to(spans, lambda s: bound_to(F.struct(s.alias("spans"), scanned(F.transform(s, lambda m: m["end"]), F.greatest).alias("covered")), marked))
    columns, hit = docs.columns, F.size(F.concat(*names)) > 0
    found = scan_secrets(docs, tuple(names)).withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*columns)
