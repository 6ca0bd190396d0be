"""Conversation structure repair: the cheapest edits of a conversation's rows by A*.

A node of the edit lattice is (rows done, state); the state is what the repaired turns end with: nothing, a system, a user or an
assistant turn. Edits lead from node to node: Keep, Rerole, Delete a row, Insert an empty turn. A turn sequence is whole if its initials read
``(s?(ua)+)?``, so in each state the next turn's role is settled but for a system turn at the start. The queue is keyed (cost plus heuristic, audit);
the heuristic is the suffix sum of what no path avoids: 4 for a row that must be deleted, 3 for a truncated one, which
costs that much if it stays. It never grows by more than an edit costs, so a node's first visit is its cheapest, with the ASCII-least audit.

A long conversation is searched in blocks of rows: for each state that a block can begin in, one search finds the cheapest audit to each
state that it can end in. An audit of a block ends with the edit of its last row, so none of them begins another: the order of two whole audits is that of the first
blocks in which they differ, and blocks are chained by (cost, order, audit) with numbers alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagweave.llm.common import partitions

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The states, and the turns that may follow in each: initial to next state.
EMPTY, SYSTEM, USER, REPLY = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": REPLY}, {"u": USER}]
WHOLE = (EMPTY, REPLY)
#: The faults of a row; one of the first two must be deleted.
BLANK, DUPLICATE, CUT_OFF, SOUND = range(4)
#: Rows that are searched at once.
BLOCK = 512
WORD = r"[^\x20\x09-\x0D]"


def from_state(initials: str, faults: bytes, start: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each state that a block can end in from ``start``: the least cost and its ASCII-least audit. After the last rows turns can be inserted too.

    initials: the first character of each row's role, or a space where it has none.
    """
    n = len(initials)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if faults[i] <= DUPLICATE else TRUNCATED if faults[i] == CUT_OFF else 0)
    queue: list[tuple[int, str, int, int]] = [(left[0], "", 0, start)]
    seen: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue and len(ends) < len(NEXT):
        total, audit, i, state = heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = total - left[i]
        if i == n:
            ends[state] = (cost, audit)
            if last and state in WHOLE:
                break
            if not last:
                continue
        steps = [(INSERT, "I", i, after) for role, after in NEXT[state].items() if role != "s"]
        if i < n:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] > DUPLICATE:
                charge = TRUNCATED if faults[i] == CUT_OFF else 0
                steps += [(REROLE + charge, "R", i + 1, after) for role, after in NEXT[state].items() if role != "s"]
                if (after := NEXT[state].get(initials[i])) is not None:
                    steps.append((charge, "K", i + 1, after))
        for more, edit, j, after in steps:
            if (j, after) not in seen:
                heappush(queue, (cost + more + left[j], audit + edit, j, after))
    return ends


def cheapest(initials: str, faults: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of all rows, the ASCII-least of equals."""
    if not initials:
        return 0, ""
    best = {EMPTY: (0, 0)}  # state: cost and order of the audits so far
    trail: list[dict[int, tuple[int, str]]] = []  # state: the state before, and the block's audit
    for at in range(0, len(initials), block):
        last = at + block >= len(initials)
        reached: dict[int, tuple[int, int, str, int]] = {}
        for start, (cost, order) in best.items():
            for end, (more, audit) in from_state(initials[at : at + block], faults[at : at + block], start, last).items():
                reached[end] = min(reached.get(end, (1 << 62, 0, "", 0)), (cost + more, order, audit, start))
        sorted_ = sorted(reached, key=lambda s: reached[s][1:3])
        best = {s: (reached[s][0], sorted_.index(s)) for s in reached}
        trail.append({s: (r[3], r[2]) for s, r in reached.items()})
    state = min((s for s in best if s in WHOLE), key=best.__getitem__)
    cost, parts = best[state][0], []
    for step in reversed(trail):
        state, audit = step[state]
        parts.append(audit)
    return cost, "".join(reversed(parts))


@dataclass
class Conversation:
    """One conversation while its rows go by: first all codes, then all texts."""

    conv: pa.Scalar
    initials: list[str] = field(default_factory=list)
    faults: bytearray = field(default_factory=bytearray)
    low: int | None = None
    high: int | None = None
    turns: int = 0
    audit: str | None = None
    cost: int = 0
    edit: int = 0
    state: int = EMPTY

    def row(self, turn: int | None, role: str, fault: int) -> None:
        self.initials.append(role[:1] or " ")
        self.faults.append(fault)
        if turn is not None and turn != self.high:  # rows come by turn
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def search(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest("".join(self.initials), bytes(self.faults))
            self.digest = hashlib.sha256()
            self.wrote = False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.wrote else "") + role + ":" + text).encode())
        self.wrote = True

    def _insert(self) -> None:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            initial = next(role for role in NEXT[self.state] if role != "s")
            self.state = NEXT[self.state][initial]
            self._put("user" if initial == "u" else "assistant", "")
            self.edit += 1

    def repaired(self, role: str, text: str) -> None:
        self.search()
        self._insert()
        edit = self.audit[self.edit]
        self.edit += 1
        if edit == "D":
            return
        if edit == "R":
            role = "user" if "u" in NEXT[self.state] else "assistant"
        self.state = NEXT[self.state][role[0]]
        self._put(role, text)

    def result(self) -> tuple:
        self.search()
        self._insert()
        count = [self.faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)]
        legal = {"su", "ua", "au"}
        illegal = sum(a + b not in legal for a, b in zip(self.initials, self.initials[1:], strict=False))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *count, illegal, self.cost, self.audit, self.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, all codes before all texts: one row for each conversation. A conversation takes a few bytes a row, its texts pass by."""
    open_: Conversation | None = None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        convs = pa.array([c.as_py() for c, _ in done], kind)
        columns = [pa.array(list(x), pa.string() if i > 5 else pa.int64()) for i, x in enumerate(zip(*(r for _, r in done), strict=True))]
        done.clear()
        return pa.RecordBatch.from_arrays([convs, *columns], ["conv_id", *(x.split()[0] for x in RESULT.split(", "))])

    for batch in batches:
        conv = batch.column(0)
        kind = conv.type
        rest = zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)
        for i, (codes, turn, role, text, fault) in enumerate(rest):
            if open_ is None or not conv[i].equals(open_.conv):
                if open_ is not None:
                    done.append((open_.conv, open_.result()))
                open_ = Conversation(conv[i])
            if codes and fault is not None:
                open_.row(turn, role, fault)
            elif fault is not None:
                open_.repaired(role, text)
        if len(done) >= 1000:
            yield flush()
    if open_ is not None:
        done.append((open_.conv, open_.result()))
        yield flush()


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place and fault of each row, by conversation: its first of blank, duplicate, truncated."""
    held = rows.repartition(partitions(rows.sparkSession), "conv_id")
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    return placed.withColumn("fault", F.when(F.col("text").isNotNull(), fault))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and RESULT: faults, least cost, audit and digest of the repaired turns of each conversation.

    Rows have conv_id, turn, role and text, and may have ``absent``: such a row has no content and only names its conversation, which
    has zeros, an empty audit and the digest of nothing if it has no other rows.

    Defined cases: rows sort by turn (null first), then role, then text; a null role or text is one space; a role that begins with none
    of s, u, a can't be kept as it is; a null conv_id is one conversation; a repeated row is a duplicate; an empty table gives no rows;
    other columns are ignored. A conversation's digest needs its rows in order, so they pass through one task, as a stream: two bytes of each
    row are held, and sorting spills.
    """
    here = ~F.coalesce("absent", F.lit(False)) if "absent" in rows.columns else F.lit(True)
    filled = [F.when(here, F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")]
    known = flagged(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled))
    twice = known.withColumn("codes", F.explode(F.array(F.lit(True), F.lit(False))))
    both = twice.select("conv_id", "codes", "turn", "role", F.when(~F.col("codes"), F.col("text")).alias("text"), F.col("fault").cast("int").alias("fault"), "place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.sortWithinPartitions("conv_id", F.desc("codes"), "place").drop("place").mapInArrow(searched, f"conv_id {kind}, {RESULT}")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn; a row that is dropped stays as ``absent``, so that no conversation is lost.

    0 of 20 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. A null is one space.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat_ws(":", text["conv_id"], text["turn"]).cast("binary")), F.lit(20))
    known = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), fate.alias("fate"))
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    some = known.filter("fate > 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.lit(False).alias("absent"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"))
    return some.drop("copy").unionByName(known.filter("fate = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("absent")))
