"""Packing, conversation repair and collocations against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bagweave.llm import collocations, packing, repair
from bagweave.llm.common import text_bytes
from tests.llm.test_llm import EMPTY, frame, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " a", "a ", "", " ", "é f é", "it's '  s 's", "a  b", "a  b", "à la  x  y", "<|endoftext|> x", "1 2 3,4", "x\n y\n\n z", "\t a", "\x1c a \x1c", "日本 語 です", "a" * 300, " " * 300, "ſ ʻ", "\u0085 a\u0085 b"]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """The bound of large, middle and small pieces (by Martello and Toth)."""
    best = 0
    for t in range(size // 2 + 1):
        large = sum(c for x, c in counts.items() if x > size - t)
        middle = [(x, c) for x, c in counts.items() if size - t >= x > size / 2]
        n, room = sum(c for _, c in middle), sum((size - x) * c for x, c in middle)
        small = sum(x * c for x, c in counts.items() if size / 2 >= x >= t)
        best = max(best, large + n + max(0, -(-(small - room) // size)))
    return best


def plan_size(counts: dict[int, int], size: int) -> int:
    bins, used = packing.plan(counts, size), Counter()
    for b in bins:
        assert b.count > 0 and sum(x * k for x, k in b.content) <= size
        for x, k in b.content:
            used[x] += k * b.count
    assert used == Counter({x: n for x, n in counts.items() if n})
    return sum(b.count for b in bins)


def fewest(items: list[int], size: int) -> int:
    """The least number of sequences, by trying all ways."""
    best = len(items)

    def put(i: int, gaps: list[int]) -> None:
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(items):
            best = len(gaps)
            return
        for k in {g: k for k, g in enumerate(gaps) if g >= items[i]}.values():
            put(i + 1, [*gaps[:k], gaps[k] - items[i], *gaps[k + 1 :]])
        put(i + 1, [*gaps, size - items[i]])

    put(0, [])
    return best


def test_plan_is_valid_and_near_the_least():
    r = random.Random(4)
    for _ in range(300):
        size = r.choice([7, 16, 30])
        counts = Counter(r.randint(1, size) for _ in range(r.randint(0, 9)))
        assert plan_size(counts, size) <= fewest(sorted(counts.elements(), reverse=True), size) + 1
    for top in (3, 300, 10**9):
        counts = {x: r.randint(0, top) for x in range(1, 2049)}
        assert plan_size(counts, 2048) <= lower_bound(counts, 2048) * 1.01
    assert plan_size({1024: 10**12 + 1}, 2048) == (10**12 + 2) // 2 and plan_size({1: 10**13}, 2048) == -(-(10**13) // 2048) and plan_size({}, 2048) == 0
    assert plan_size({1000: 5, 600: 5, 300: 5, 148: 5}, 2048) == 5  # three lengths fill a gap


def test_sums_of_lengths_are_kept():
    r = random.Random(5)
    counts = np.array([0, *(r.randint(0, 2) for _ in range(40))])
    index = packing.Index(counts.copy())
    while True:
        have = [x for x in range(41) if index.counts[x]]
        for times, sums in ((2, index.two), (3, index.three)):
            want = Counter(sum(p) for p in itertools.product(have, repeat=times))
            assert [int(v) for v in sums] == [want[s] for s in range(41)]
        if not have:
            return
        x = r.choice(have)
        index.take(x, r.randint(1, int(index.counts[x])))


def test_chunks_have_the_ids_of_the_text():
    import pyarrow as pa

    r = random.Random(6)
    texts = [*ODD, *("".join(r.choice(ODD) + r.choice(["", " ", "  ", "."]) for _ in range(8)) for _ in range(200)), prose(300, r)]
    own, plain = packing.Tokens(BPE), Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    for some in (texts, texts[::-1], texts[:3]):
        ids, at = own(*text_bytes(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def test_packing(spark):
    r = random.Random(7)
    texts = {i: prose(r.choice([3, 30, 300, 900]), r) for i in range(60)} | {100 + i: t for i, t in enumerate(ODD)} | {200: prose(9000, r)}
    docs = frame(spark, texts, [(300, None, "en", "s"), (300, None, "en", "s"), (None, "one", "en", "s")])
    rows = packing.packed(docs, BPE).collect()
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    of, places = defaultdict(list), defaultdict(list)
    for x in rows:
        of[x["doc_id"]].append(x)
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, t in [*texts.items(), (None, "one")]:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at, first = 0, len(ids) % 2048 or 2048
        for k, x in enumerate(sorted(of[i], key=lambda x: x["piece"])):
            assert (x["piece"], x["start"], x["length"]) == (k, at, 2048 if k else first)
            assert x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    assert len(of[300]) == 2 and all(x["length"] == 1 for x in of[300])
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    counts = Counter(x["length"] for x in rows)
    assert len(places) <= lower_bound(counts, 2048) + 1
    whole = packing.sequences(docs, BPE).collect()
    assert len(whole) == len(places) and all(x["n_tokens"] == sum(p["length"] for p in x["pieces"]) for x in whole)
    assert packing.packed(spark.createDataFrame([], EMPTY), BPE).count() == 0


# --- conversations ------------------------------------------------------------------------------


def by_table(initials: str, faults: bytes) -> tuple[int, str]:
    """Least (cost, audit) over all states, row after row."""
    nxt = repair.NEXT

    def with_inserts(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                for role, t in nxt[s].items():
                    if role != "s" and (t not in states or (c + 3, a + "I") < states[t]):
                        states[t] = (c + 3, a + "I")
        return states

    states = {0: (0, "")}
    for role, fault in zip(initials, faults, strict=True):
        new: dict[int, tuple[int, str]] = {}
        for s, (c, a) in with_inserts(states).items():
            ways = [(s, c + 4, a + "D")]
            if fault > 1:
                more = 3 if fault == 2 else 0
                ways += [(t, c + 3 + more, a + "R") for x, t in nxt[s].items() if x != "s"]
                ways += [(nxt[s][role], c + more, a + "K")] if role in nxt[s] else []
            for t, cost, audit in ways:
                new[t] = min(new.get(t, (1 << 60, "")), (cost, audit))
        states = new
    return min(v for s, v in with_inserts(states).items() if s in (0, 3))


def test_search_finds_the_cheapest_and_least_audit():
    r = random.Random(8)
    for _ in range(1500):
        n = r.randint(0, 14)
        initials = "".join(r.choice("suuaaa x"[: r.choice([6, 8])]) for _ in range(n))
        faults = bytes(r.choice([0, 1, 2, 3, 3, 3]) for _ in range(n))
        want = by_table(initials, faults)
        assert all(repair.cheapest(initials, faults, block) == want for block in (1, 2, 3, 5, 512))


def test_a_long_conversation_is_searched_in_blocks():
    r = random.Random(9)
    n = 20_000
    initials = "".join(r.choice("suaua") for _ in range(n))
    faults = bytes(r.choice([0, 1, 2, 3, 3, 3, 3]) for _ in range(n))
    cost, audit = repair.cheapest(initials, faults)
    assert len(audit.replace("I", "")) == n
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + 3 * sum(f == 2 and e != "D" for f, e in zip(faults, audit.replace("I", ""), strict=True))
    assert cost == by_cost(initials, faults)


def by_cost(initials: str, faults: bytes) -> int:
    costs = {0: 0}
    for role, fault in zip(initials, faults, strict=True):
        for _ in range(3):
            for s, c in list(costs.items()):
                for x, t in repair.NEXT[s].items():
                    if x != "s":
                        costs[t] = min(costs.get(t, 1 << 60), c + 3)
        new = {s: c + 4 for s, c in costs.items()}
        if fault > 1:
            for s, c in costs.items():
                for x, t in repair.NEXT[s].items():
                    if x == role or x != "s":
                        new[t] = min(new.get(t, 1 << 60), c + (fault == 2) * 3 + (0 if x == role else 3))
        costs = new
    return min(costs.get(0, 1 << 60), costs.get(3, 1 << 60), costs.get(2, 1 << 60) + 3, costs.get(1, 1 << 60) + 6)


def plain_repair(rows: list[tuple]) -> dict:
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in own:
            words = text.strip(" \t\n\v\f\r")
            faults.append(0 if not words else 1 if (role, text) in seen else 3 if words[-1] in ".!?" else 2)
            seen.add((role, text))
        initials = "".join(role[:1] or " " for _, role, _ in own)
        cost, audit = by_table(initials, bytes(faults))
        turns = [t for t, _, _ in own if t is not None]
        done, rest = [], iter(own)
        for edit in audit:
            row = next(rest) if edit != "I" else (None, "", "")
            if edit != "D":
                before = done[-1][0][:1] if done else ""
                done.append((row[1] if edit == "K" else "assistant" if before == "u" else "user", row[2]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in range(3)), sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest())
    return out


def test_repair(spark):
    r = random.Random(10)
    rows = [(c, r.choice([t, t, t, t + 1, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys"]), r.choice(["ok.", "yes!", "no", "", None, " \t", "why?", "é.", "a.\n \n", "same."])) for c in range(80) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (99, None, None, None), (-1, -5, "user", "hi."), (-1, 3, "assistant", "a!")]
    rows += [(7, i, ["user", "assistant"][i % 2], f"line {i}.") for i in range(1500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("place", "fault", "codes", "fate", "copy", "same")}).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(repair.damaged(table)).collect()}
    assert got == plain_repair(rows)
    assert repair.repaired(repair.damaged(table.limit(0))).count() == 0


# --- collocations ---------------------------------------------------------------------------------


def plain_phrases(rows, least: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    some = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    gone = {(lang, p[i : i + k]) for (lang, p), a in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    out = defaultdict(list)
    for (lang, p), a in some.items():
        if (lang, p) not in gone:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])]


def test_collocations(spark, monkeypatch):
    r = random.Random(11)
    words = ["the", "Of", "to", "a\x01", "a", "b", "new", "york", "é", "Ünd", "x"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r"]) for _ in range(n))
    rows = [(i, say(r.randint(0, 60)), r.choice(["en", "en", "en", "de", None, "und", "a b"]), "s") for i in range(200)]
    rows += [(None, "new york " * 400, "en", "s"), (1, "", "en", "s"), (2, None, None, "s"), (3, "only here", "fr", "s"), (4, "b " * 90_000, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("key", "n", "f", "phrase", "run", "rank")}).repartition(3)
    for size in (1 << 18, 7):
        monkeypatch.setattr(collocations, "ROWS", size)
        for least, top in ((30, 2000), (3, 5)):
            assert sorted(map(tuple, collocations.collocations(docs, top, least).collect())) == sorted(plain_phrases([(x[2], x[1]) for x in rows], least, top))
    assert collocations.collocations(spark.createDataFrame([], EMPTY)).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    big = 4 * 10**18
    rows = [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 2)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()
    assert [tuple(x) for x in got] == [("en", "a b", big, big + 1, big + 2, 2000000 * big // (2 * big + 3))]


def test_long_text_is_cut_at_the_end_of_a_piece():
    raw = np.frombuffer(b"aa bb. cc dd! ee ff gg hh ii jj kk, ll" * 3, np.uint8)
    parts = list(collocations.short_runs(raw, np.array([0, len(raw)]), 10))
    assert b"".join(p.tobytes() for p, _ in parts) == raw.tobytes() and len(parts) > 6
    assert all(p[-1] in b".,!" for p, _ in parts[:-1]) and all(list(at) == [0, len(p)] for p, at in parts)
