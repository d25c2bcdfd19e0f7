import hashlib
import math
import random

import numpy as np
import pytest

from recordloom.llm import hilbert_negatives, subvector_kmeans
from recordloom.llm.hilbert_negatives import hilbert_key, mine_negatives
from recordloom.llm.subvector_kmeans import cluster_vectors

#: Names that the operators use inside, on a table that has them too.
KIND = "vec_id long, embedding array<float>, label int, id string, q int, block string, tile int, cluster string, rank int, score double"
EXTRA = ("x", 1, "y", 2, "z", 3, 0.5)


def vectors(spark, dims, n=150, seed=5, copies=60):
    rng = random.Random(seed)
    base = [rng.uniform(-1, 1) for _ in range(dims)]
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, base, 1) for i in range(copies)]                          # one vector many times: ties
    rows += [(900, None, 1), (901, [None] * dims, 1), (902, [math.nan] * dims, 0), (903, [math.inf] * dims, 2), (904, rows[0][1], None)]
    rows += [rows[3], rows[10], (None, rows[5][1], 2)]                           # repeated rows, a null id
    rows += [(905, [1e30] + [0.5] * (dims - 1), 2), (906, [0.5] * (dims - 1), 1), (907, [], 0)]
    return rows, spark.createDataFrame([(*r, *EXTRA) for r in rows], KIND).repartition(5)


def kept(rows, scale, dims=None):
    out = []
    for i, v, label in rows:
        if v is not None and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v):
            held = [max(-2.0**27, min(2.0**27, float(np.float32(x)) * scale)) for x in v]
            out.append((i, [math.floor(x) for x in held], label))
    return out


def brute_clusters(rows, dims, k=8, rounds=10):
    rows = [(i, q) for i, q, _ in kept(rows, 1024, dims)]

    def name(r):
        return (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])

    centroids = [q for _, q in sorted(rows, key=name)[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in rows]
        for c in range(len(centroids)):
            mine = [q for (_, q), o in zip(rows, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(q)[::-1]) for i, q in rows]
    spent = {c: sum(d for _, o, d in found if o == c) for c in range(len(centroids))}
    return sorted(((i, c, d, spent[c], sum(spent.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for i, c, d in found), key=str)


@pytest.mark.parametrize("dims,chunk", [(64, 32768), (64, 40), (5, 16)])
def test_clusters_equal_brute_force(spark, monkeypatch, dims, chunk):
    monkeypatch.setattr(subvector_kmeans, "CHUNK_ROWS", chunk)
    rows, table = vectors(spark, dims)
    got = cluster_vectors(table, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, dims)


def test_few_vectors_and_none(spark):
    rows, table = vectors(spark, 4, n=20, copies=0)
    got = cluster_vectors(table.where("vec_id < 3"), dims=4)
    assert {r.cluster for r in got.collect()} <= {0, 1, 2}
    empty = cluster_vectors(table.where("vec_id < 0"), dims=4)
    assert empty.columns == got.columns and empty.collect() == []


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    for rows in (rng.integers(-3, 3, (500, 7)), np.repeat(rng.integers(-900, 900, (3, 8)), 100, axis=0)):
        codes, books = subvector_kmeans._dictionaries(rows)
        assert (np.concatenate([b[c] for c, b in zip(codes.T, books)], axis=1) == rows).all()
    assert len(books) == 1 and len(books[0]) == 3          # copies: one block of all dimensions


def brute_negatives(rows, positives=5, negatives=10, every=100):
    rows = [(i, q, label) for i, q, label in kept(rows, 256) if i is not None and label is not None]

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, q, label in rows:
        if a % every:
            continue
        scored = sorted(((-product(q, p), i, o) for i, p, o in rows))
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:positives]:
            fits = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, i, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block,page", [(256, 128), (7, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, page):
    monkeypatch.setattr(hilbert_negatives, "BLOCK", block)
    monkeypatch.setattr(hilbert_negatives, "PAGE", page)
    monkeypatch.setattr(hilbert_negatives, "TILE", 4)
    rows, table = vectors(spark, 6)
    got = mine_negatives(table, every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, every=10)


def test_negatives_of_nothing(spark):
    _, table = vectors(spark, 3)
    assert mine_negatives(table.where("vec_id < 0")).collect() == []
    assert mine_negatives(table.where("label = 1")).collect() == []


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """Far apart groups of vectors: an anchor's windows don't read the blocks of the others."""
    monkeypatch.setattr(hilbert_negatives, "BLOCK", 8)
    seen = []
    visit = hilbert_negatives.BlockSearch._visit
    monkeypatch.setattr(hilbert_negatives.BlockSearch, "_visit",
                        lambda self, pairs, *rest: (seen.append((pairs.select("block").distinct().count(), self.blocks.count())), visit(self, pairs, *rest))[1])
    rows = [(i, [math.cos(i // 40) + i / 9999, math.sin(i // 40), i // 40 / 9], i // 20) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    mine_negatives(table, every=400).collect()
    assert seen and all(2 * read < blocks for read, blocks in seen)


def test_hilbert_curve_is_a_path():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        points = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        order = points[np.argsort(hilbert_key(points, bits))]
        assert len(np.unique(hilbert_key(points, bits))) == side**dims
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
