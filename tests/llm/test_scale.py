"""Texts of very many runs, conversations of very many turns, benchmarks with one stem: right, and in time."""

from __future__ import annotations

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from bagweave.llm import chat, decontamination, quality_rules, secrets
from bagweave.llm.common import scanned, text_bytes
from tests.llm import brute
from tests.llm.test_llm import spans_of


def test_scans_of_arrays(spark):
    r = random.Random(1)
    rows = [[r.randint(-9, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000, 70_000)]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>").select("x", scanned(F.col("x")).alias("sums"), scanned(F.col("x"), F.greatest).alias("most"))
    for row in df.collect():
        assert row["sums"] == [0, *np.cumsum(row["x"])] and row["most"] == [0, *np.maximum(np.maximum.accumulate(row["x"]), 0)] if row["x"] else row["sums"] == [0]


def test_many_turns(spark):
    turns = [(1, i, "user" if i % 3 else "assistant", f"t{i}<") for i in range(100_000)]
    began = time.time()
    got = chat.chat_digest(chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert time.time() - began < 60
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    assert got["n_turns"] == 100_000 and got["turns_sha256"] == brute.sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
    assert got["loss_sha256"] == brute.sha(loss) and got["loss_chars"] == len(loss)


def test_many_runs(spark):
    r = random.Random(2)
    run = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(22))
    small = " ".join(("token=" if i % 2 else "") + run() for i in range(700))
    large = "\n".join(("token=" if i % 50 == 0 else "") + run() for i in range(30_000))
    docs = spark.createDataFrame([(1, small), (2, large)], "doc_id long, text string")
    began = time.time()
    got = {x["doc_id"]: x for x in secrets.secret_digest(docs).collect()}
    assert time.time() - began < 120
    assert got[1]["spans"].split(",") == spans_of(small)
    assert [got[2][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")] == list(brute.secrets(large))
    assert got[2]["spans"].count("entropy") > 15_000
    began = time.time()
    clean = {x["doc_id"]: x["text"] for x in secrets.redact_secrets(docs).collect()}
    assert time.time() - began < 200
    for i, text in ((1, small), (2, large)):
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(","))
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert clean[i] == "".join(parts) + text[at:]


def test_items_with_one_stem_cost_no_more_than_others():
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    stem = say(12)
    texts = [f"{say(200)} {stem} {say(200)}" for _ in range(60)]
    raw, at = text_bytes(__import__("pyarrow").array(texts))
    took = {}
    for name, head in (("stem", stem + " "), ("plain", "")):
        items = [(head + say(24)).encode() for _ in range(4000)] + [texts[7].encode()[300:420]]
        place = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        sets, _ = decontamination.shingle_sets(np.frombuffer(b"".join(items), np.uint8), place)
        index = decontamination.Items(list(range(len(items))), [1] * len(items), sets, 0.75)
        began = time.time()
        found = decontamination.matches(index, raw, at, 0.75)
        took[name] = time.time() - began
        assert {(i, j) for i, j, _ in found} == set(brute.leaks(dict(enumerate(texts)), {j: x.decode() for j, x in enumerate(items[-1:], 4000)}))
    assert took["stem"] < 1 + 3 * took["plain"]


def test_cutoffs_are_exact_quantiles(spark):
    r = random.Random(4)
    rows = [(lang, *(r.choice([0.0, r.random(), r.randint(0, 20) / 20]) for _ in range(4))) for lang, n in (("a", 1), ("b", 2), ("c", 997), ("d", 30_000)) for _ in range(n)]
    df = spark.createDataFrame(rows, ["lang", *quality_rules.RATES])
    for row in quality_rules.cutoffs_by_level(df).collect():
        for k, rate in enumerate(quality_rules.RATES, 1):
            values = sorted(x[k] for x in rows if x[0] == row["stratum"])
            assert row[f"cut_{rate}"] == [values[max(1, math.ceil((1 - level) * len(values))) - 1] for level in quality_rules.LEVELS]
