"""Path codes of whole tables against a plain breadth-first search."""

from __future__ import annotations

import math

from bagweave.operators.graph import bounded_depths
from bagweave.plans import registry


def test_path_codes_match_breadth_first_search(spark, tmp_path):
    """A line of 45 atoms, so that paths end at 31 steps, a ring of 6 and one atom alone, with ids above 40 too."""
    places = {7 * i: (0.05 * i, 0.0, 0.0) for i in range(45)} | {1000 + i: (math.cos(i * math.pi / 3) * 0.05, math.sin(i * math.pi / 3) * 0.05, 5.0) for i in range(6)} | {2000: (0.0, 9.0, 0.0)}
    data = [(i, 0, [*map(float, p), 1.0, 0.0, 0.0]) for i, p in places.items()]
    spark.createDataFrame(data, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    beside = {i: [j for j, q in places.items() if i != j and math.dist(p, q) * 10 <= 0.6] for i, p in places.items()}
    expected = set()
    for source in places:
        depths, edge = {source: 0}, [source]
        while edge:
            at = edge.pop(0)
            for j in beside[at]:
                if j not in depths and depths[at] < 31:
                    depths[j] = depths[at] + 1
                    edge.append(j)
        expected |= {(source, dst, depth) for dst, depth in depths.items()}
    assert max(depth for _, _, depth in expected) == 31
    assert sorted((r["src"], r["dst"], r["depth"]) for r in registry.QUERIES["path_codes"](spark, str(tmp_path)).collect()) == sorted(expected)


def test_depths_of_more_sources_than_a_row_has_bits(spark):
    """Two rings of one graph, 1,500 sources in all: a row holds a block's bits, and the edges are not joined with pairs."""
    n = 1500
    links = [(i, i + 1) for i in range(n - 1)] + [(0, 99)] + [(3000, 3001)]
    edges = spark.createDataFrame([*links, *((b, a) for a, b in links)], "src long, dst long")
    sources = spark.createDataFrame([(i, -i) for i in [*range(n), 3000, 3001, 5000]], "id long, place long")
    beside = {}
    for a, b in [*links, *((b, a) for a, b in links)]:
        beside.setdefault(a, []).append(b)
    expected = set()
    for source in [*range(n), 3000, 3001, 5000]:
        depths, at = {source: 0}, [source]
        for depth in range(1, 5):
            at = [v for u in at for v in beside.get(u, []) if depths.setdefault(v, depth) == depth]
        expected |= {(source, v, d) for v, d in depths.items()}
    got = [tuple(r) for r in bounded_depths(edges, sources, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
