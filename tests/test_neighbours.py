"""Nearest neighbours without a radius, spanning trees and density clusters against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from bagweave.operators import clustering, neighbours


def points(seed: int, n: int, dims: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 0.05, (n // 3, dims)), r.normal(3, 0.5, (n // 3, dims)), r.uniform(-10, 10, (n - 2 * (n // 3), dims))])
    x[: n // 10] = x[0]  # many points of one place
    x[-1] = 1000.0
    return np.round(x, 3)


def frame(spark, x: np.ndarray, by=None):
    rows = [(int(7 * i % 1009), None if by is None else by[i], *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, owner string, " + ", ".join(f"v{k} double" for k in range(x.shape[1]))).repartition(3)


@pytest.mark.parametrize(("dims", "k"), [(1, 3), (3, 5), (4, 2)])
def test_all_neighbours(spark, dims, k):
    x = points(dims, 150, dims)
    by = ["a" if i % 2 else "b" if i % 3 else "c" for i in range(len(x))]
    by[5:8] = ["alone", "two", "two"]
    by[9] = None
    got = {}
    for r in neighbours.all_neighbours(frame(spark, x, by), "owner", "id", [f"v{i}" for i in range(dims)], k).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["d"]))
    for i, p in enumerate(x):
        near = sorted((float(np.sqrt(sum((p[c] - q[c]) ** 2 for c in range(dims)))), 7 * j % 1009) for j, q in enumerate(x) if j != i and by[j] == by[i] and by[i] is not None)[:k]
        own = sorted(got.get(7 * i % 1009, []))
        assert [(d, rank) for rank, d, _ in own] == [(j, n) for n, (_, j) in enumerate(near, 1)]
        assert np.allclose([d for _, _, d in own], [d for d, _ in near])
    assert neighbours.all_neighbours(frame(spark, x, by).limit(0), "owner", "id", ["v0"], k).count() == 0


def plain_tree(x: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """Prim's tree over all distances."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    best, via, done, edges, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        done[at] = True
        closer = ~done & (reach[at] < best)
        best[closer], via[closer] = reach[at][closer], at
        nxt = int(np.where(done, np.inf, best).argmin())
        edges.append((float(best[nxt]), int(via[nxt]), nxt))
        at = nxt
    return sorted(edges)


def plain_labels(x: np.ndarray, least: int, min_samples: int) -> np.ndarray:
    w, a, b = (np.array(c) for c in zip(*plain_tree(x, min_samples), strict=True))
    return clustering.condensed_labels(a, b, w, len(x), [least])[0]


def groups(labels) -> set[frozenset]:
    by: dict = {}
    for i, k in labels:
        by.setdefault(k, set()).add(i)
    return {frozenset(v) for k, v in by.items() if k is not None and k != -1 and not str(k).endswith("NOISE")}


def test_two_groups_and_noise():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[2.5, 2.5]]])
    k = plain_labels(x, 8, 4)
    assert len(set(k[:30])) == 1 and len(set(k[30:60])) == 1 and k[0] != k[30]
    assert (plain_labels(x[:10], 8, 4) == -1).all()


def test_order_of_equal_edges_does_not_count():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, (60, 2)) + 6 * (np.arange(60)[:, None] % 3), 1)
    edges = plain_tree(x, 4)
    want = None
    for seed in range(5):
        np.random.default_rng(seed).shuffle(edges)
        w, a, b = (np.array(c) for c in zip(*sorted(edges, key=lambda e: e[0]), strict=True))
        got = groups(enumerate(clustering.condensed_labels(a, b, w, 60, [5])[0].tolist()))
        want = got if want is None else want
        assert got == want


@pytest.mark.parametrize(("min_samples", "few"), [(4, 50_000), (1, 0)])
def test_spanning_tree_and_clusters(spark, monkeypatch, min_samples, few):
    """With the driver's way for few edges, and in rounds for any number."""
    monkeypatch.setattr(neighbours, "FEW", few)
    x = points(9, 240 if few else 60, 2)
    ids = [7 * i % 1009 for i in range(len(x))]
    df = frame(spark, x).drop("owner")
    tree = clustering.density_tree(df, "id", ["v0", "v1"], min_samples).collect()
    assert len(tree) == len(x) - 1
    assert np.allclose(sorted(r["w"] for r in tree), [w for w, _, _ in plain_tree(x, min_samples)])
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in tree:
        a, b = root(r["a"]), root(r["b"])
        assert a != b
        up[a] = b
    got = clustering.phenotypes(df, "id", ["v0", "v1"], "G", 12 if few else 5, min_samples).collect() if few else []
    if not few:
        return
    assert groups((r["id"], r["phenotype"]) for r in got) == groups(zip(ids, plain_labels(x, 12, min_samples).tolist(), strict=True))
    assert min(r["id"] for r in got if r["phenotype"] == "G001") == min(r["id"] for r in got if not r["phenotype"].endswith("NOISE"))


def test_a_grid_of_sizes_gates_clusters(spark):
    rng = np.random.default_rng(3)
    apart = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in (0, 8)])
    rows, report = clustering.stable_phenotypes(frame(spark, apart), "id", ["v0", "v1"], "P", [5, 8, 1, 500], 3, 0.8)
    told = report.first()
    assert (told["count"], told["clusters"], told["robust"], told["reason"]) == (80, 2, True, "stable_multicluster") and told["minimum_ari"] >= 0.8
    labels = [plain_labels(apart, s, 3) for s in (5, 8)]
    assert groups((r["id"], r["phenotype"]) for r in rows.collect()) == groups(zip([7 * i % 1009 for i in range(80)], labels[0].tolist(), strict=True))
    pairs = list(itertools.combinations(range(80), 2))
    same = [np.array([k[a] == k[b] for a, b in pairs]) for k in labels]
    expect = same[0].sum() * same[1].sum() / len(pairs)
    assert told["minimum_ari"] == pytest.approx(((same[0] & same[1]).sum() - expect) / ((same[0].sum() + same[1].sum()) / 2 - expect))
    rows, report = clustering.stable_phenotypes(frame(spark, apart), "id", ["v0", "v1"], "P", [5], 3, 0.8)
    assert report.first()["reason"] == "insufficient_grid_support" and {r["phenotype"] for r in rows.collect()} == {"P_NOISE"}
    rows, report = clustering.stable_phenotypes(frame(spark, np.ones((20, 2))), "id", ["v0", "v1"], "P", [5, 6], 3, 0.8)
    assert report.first()["reason"] == "constant_descriptors"
    rows, report = clustering.stable_phenotypes(frame(spark, rng.uniform(0, 1, (60, 2))), "id", ["v0", "v1"], "P", [5, 25], 3, 0.99)
    assert report.first()["reason"] == "no_robust_multicluster_solution" and {r["phenotype"] for r in rows.collect()} == {"P_NOISE"}
