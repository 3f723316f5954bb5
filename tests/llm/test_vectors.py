"""Clusters and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantora.llm import clusters, features, forest, neighbours, vectors

UPSERT = "req_no long, id long, coll_name string, vector array<float>, metadata map<string,string>, grp int, rep int"
CONFIG = "coll_name string, dim int, distance string, vector int"


def sample(seed=0, n=240, dim=16, copies=30):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    m = (centres[rng.integers(0, 20, n)] + 0.25 * rng.standard_normal((n, dim)) * rng.uniform(0.2, 2, (n, 1))).astype(np.float32)
    m[:copies] = m[0]  # a hot group of exact copies
    m[copies : copies + 5] = m[copies] * np.array([[1], [2], [4], [0.5], [8]], np.float32)
    return m * rng.choice([0.01, 1, 100], (n, 1)).astype(np.float32) if seed % 2 else m


def frame(spark, m, coll="c", start=0):
    return spark.createDataFrame([(i, start + i, coll, [float(x) for x in v], None, 1, 1) for i, v in enumerate(m)], UPSERT)


def exact_sims(m):
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 12)


def brute_pairs(m, k=5, least=0.8):
    s, out = exact_sims(m), set()
    for i in range(len(m)):
        near = sorted((-s[i, j], j) for j in range(len(m)) if j != i and s[i, j] >= least)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def brute_roots(m, least=0.8):
    near = exact_sims(m) >= least
    root = np.arange(len(m))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(m))])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("seed", [0, 1])
def test_neighbours_are_exact_within_the_budget(spark, seed):
    m = sample(seed)
    got = neighbours.similar_pairs(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG))
    assert {tuple(r) for r in got.collect()} == brute_pairs(m)


def test_recall_beyond_the_budget(spark):
    m = sample(2, n=1500, copies=1)
    got = neighbours.similar_pairs(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG), budget=128)
    want = brute_pairs(m)
    assert len({tuple(r) for r in got.collect()} & want) >= 0.9 * len(want)


def test_recall_in_a_crowd(spark):
    rng = np.random.default_rng(5)
    m = (rng.standard_normal(16) + 0.2 * rng.standard_normal((1200, 16))).astype(np.float32)
    got = neighbours.similar_pairs(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG), budget=64)
    want = brute_pairs(m)
    assert len({tuple(r) for r in got.collect()} & want) >= 0.9 * len(want)


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters(spark, seed):
    m = sample(seed)
    got = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)))
    root = brute_roots(m)
    size = np.bincount(root, minlength=len(m))
    assert {(r.id, r.cluster_id, r.size) for r in got.collect()} == {(i, r, size[r]) for i, r in enumerate(root) if size[r] >= 3}


def test_clusters_with_small_blocks(spark):
    m = sample(4, n=900)
    got = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)), region=64, leaves=16, merged=64)
    root = brute_roots(m)
    size = np.bincount(root, minlength=len(m))
    want = {(i, r) for i, r in enumerate(root) if size[r] >= 3}
    assert len({(r.id, r.cluster_id) for r in got.collect()} & want) >= 0.9 * len(want)


def test_typical_members(spark):
    m = sample(0)
    found = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)))
    rows = clusters.typical(found, top=2).collect()
    root = brute_roots(m)
    u = m.astype(np.float64) / np.linalg.norm(m, axis=1, keepdims=True)
    for r in (r for r in rows if r.place == 1):
        own = np.flatnonzero(root == r.cluster_id)
        mean = u[own].mean(axis=0)
        sims = u[own] @ mean / np.linalg.norm(mean)
        assert r.size == len(own) and abs(sims.max() - r.sim) < 1e-5 and abs(r.radius - np.sqrt(max(0, 1 - mean @ mean))) < 1e-5


def test_unusable_repeated_and_empty(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 0.0]
    rows = [(1, 1, "c", one, None, 1, 1), (2, 2, "c", one, None, 1, 1), (3, 3, "c", [2.0, 0.0], None, 1, 1), (4, 4, "c", None, None, 1, 1), (5, 5, "c", [], None, 1, 1), (6, 6, "c", [1.0], None, 1, 1), (7, 7, "c", [0.0, 0.0], None, 1, 1)]
    rows += [(8, 8, "c", [nan, 1.0], None, 1, 1), (9, 9, "c", [inf, 1.0], None, 1, 1), (10, None, "c", one, None, 1, 1), (11, 11, None, one, None, 1, 1), (12, 12, "other", one, None, 1, 1)]
    rows += [(13, 2, "c", [0.0, 1.0], None, 1, 1), (14, 2, "c", None, None, 1, 1), (15, 2, "c", one, None, 1, 1), (15, 2, "c", one, None, 1, 1), (16, 16, "c", [1e-30, 0.0], None, 1, 1), (17, 17, "c", [3e38, 0.0], None, 1, 1)]
    df, config = spark.createDataFrame(rows, UPSERT), spark.createDataFrame([("c", 2, "l2", 0), ("c", 2, "l2", 0), (None, 2, "l2", 0), ("d", None, "", 0)], CONFIG)
    assert sorted(r.id for r in vectors.usable(df, config).collect()) == [1, 2, 3, 16, 17]
    books = spark.createDataFrame([], "codebook_id long, subspace int, subvector_dim int, centroids array<array<float>>")
    got = sorted((r.member_id, r.cluster_id) for r in clusters.cluster_members(df, config, books).collect())
    assert got == [(i, 1) for i in (1, 2, 3, 16, 17)]
    assert len(neighbours.similar_pairs(df, config).collect()) == 10
    none = df.limit(0)
    assert clusters.cluster_members(none, config, books).collect() == [] and neighbours.similar_pairs(none, config).collect() == []


def test_codebooks(spark):
    codes = [[0.0, 1.0], [0.03, 1.0], [0.06, 1.0], [0.5, 0.5], None, [0.0, 0.0], [0.0], [float("nan"), 1.0], [0.06, 1.04], []]
    books = spark.createDataFrame([(3, 0, 2, codes), (4, 0, 2, []), (5, 0, 2, None), (None, 0, 2, codes), (6, 0, None, codes)], "codebook_id long, subspace int, subvector_dim int, centroids array<array<float>>")
    assert sorted((r.codebook_id, r.pos, r.first, r.size) for r in clusters.code_clusters(books).collect()) == [(3, i, 0, 4) for i in (0, 1, 2, 8)]


def test_feature_trees_are_bounded_and_merge():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 8))
    m = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.standard_normal((3000, 8))
    trees = []
    for part in np.array_split(m, 5):
        t = features.FeatureTree(8, 64)
        t.add_rows(part)
        assert len(t) <= 64 and t.n.sum() == len(part) and np.allclose(t.ls.sum(axis=0), part.sum(axis=0)) and np.isclose(t.ss.sum(), (part**2).sum())
        assert np.bincount(t.node).max() <= features.FANOUT
        trees.append(t)
    both = features.FeatureTree(8, 64)
    for t in trees:
        both.add(t.n, t.ls, t.ss)
    assert len(both) <= 64 and both.n.sum() == 3000 and np.allclose(both.ls.sum(axis=0), m.sum(axis=0))


def test_ward_joins_the_cheapest_pair_first():
    rng = np.random.default_rng(1)
    for most in (1e9, 12):
        n, c = rng.integers(1, 5, 25).astype(float), rng.standard_normal((25, 3))
        groups = [[i] for i in range(25)]

        def cost(a, b):
            na, nb = n[a].sum(), n[b].sum()
            if na + nb > most:
                return np.inf
            return na * nb / (na + nb) * ((np.average(c[a], axis=0, weights=n[a]) - np.average(c[b], axis=0, weights=n[b])) ** 2).sum()

        while len(groups) > 1:
            best = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] == np.inf:
                break
            groups[best[1]] += groups.pop(best[2])
        label = features.ward(n, c, most)
        assert sorted(sorted(g) for g in groups) == sorted(np.flatnonzero(label == x).tolist() for x in np.unique(label))


def exact_clusters(m):
    root = brute_roots(m)
    size = np.bincount(root, minlength=len(m))
    return {(i, r) for i, r in enumerate(root) if size[r] >= 3}


@pytest.mark.parametrize("depth", [1, 3])
def test_clusters_of_a_crowd(spark, depth):
    """More rows than a region holds lie within the radius of one cluster, others at its rim."""
    rng = np.random.default_rng(6)
    d = rng.standard_normal(16)
    m = np.concatenate([d + 0.02 * rng.standard_normal((500, 16)), d + rng.choice([0.2, 0.25, 0.4], (60, 1)) * rng.standard_normal((60, 16)), rng.standard_normal((40, 16))])
    m = m[rng.permutation(len(m))].astype(np.float32)
    got = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)), region=16, leaves=8, merged=16, depth=depth)
    assert {(r.id, r.cluster_id) for r in got.collect()} == exact_clusters(m)


def test_regions_that_are_many_meet_rows_in_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(clusters, "is_small", lambda df: False)
    m = sample(0)
    got = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)), region=32, leaves=16, merged=32)
    want = exact_clusters(m)
    assert len({(r.id, r.cluster_id) for r in got.collect()} & want) >= 0.95 * len(want)


def test_prefix_blocks():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << forest.BITS, 5000))
    h[1000:4000] = h[1000]
    h.sort()
    cuts = forest.prefix_blocks(h, 256)
    assert cuts[0][0] == 0 and cuts[-1][1] == 5000 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and max(b - a for a, b in cuts) <= 256


def one_direction(n=700, others=100):
    """Many vectors of one direction and different norms, beside a crowd of others near them."""
    rng = np.random.default_rng(8)
    d = rng.standard_normal(16)
    m = np.concatenate([d * rng.uniform(0.1, 50, (n, 1)), d + 0.3 * rng.standard_normal((others, 16)), rng.standard_normal((others, 16))])
    return m[rng.permutation(len(m))].astype(np.float32)


def test_neighbours_of_one_direction(spark):
    m = one_direction()
    got = neighbours.similar_pairs(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG), budget=128)
    got, want = {tuple(r) for r in got.collect()}, brute_pairs(m)
    assert len(got & want) >= 0.99 * max(len(got), len(want))


def test_clusters_of_one_direction(spark):
    m = one_direction()
    got = clusters.members(vectors.usable(frame(spark, m), spark.createDataFrame([("c", 16, "l2", 0)], CONFIG)), region=128, leaves=64, merged=64)
    root = brute_roots(m)
    size = np.bincount(root, minlength=len(m))
    assert {(r.id, r.cluster_id) for r in got.collect()} == {(i, r) for i, r in enumerate(root) if size[r] >= 3}


def test_cuts_through_equal_strings_overlap():
    cuts = forest.prefix_blocks(np.zeros(1000, np.int64), 128, overlap=16)
    assert cuts[0][0] == 0 and cuts[-1][1] == 1000 and all(a[1] - b[0] == 16 for a, b in zip(cuts, cuts[1:])) and max(b - a for a, b in cuts) <= 128


def test_packing_is_lossless():
    for m in (np.float32([[0.5, -2], [1, 3]]), np.float32([[0.1, 1e30], [1, 2]])):
        a = vectors.pack(m)
        kind = np.float16 if len(a[0].as_py()) == 4 else np.float32
        assert (np.frombuffer(b"".join(a.to_pylist()), kind).reshape(2, 2).astype(np.float32) == m).all()
