"""Centroid clustering against all distances in plain integers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from pavemetric.llm import ball_tree

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance long, v string, no_id boolean"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in e)]
    cents = [v for _, v in sorted(kept, key=lambda r: (sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    return sorted(repr((i, c, d, inertia[c], sum(inertia.values()), sha256(",".join(map(str, cents[c])).encode()).hexdigest())) for i, c, d in found)


def vectors(seed, n=300, dims=8, size=1.0):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-size, size) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, size / 20) for x in rng.choice(hubs)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(40)] + [rows[0], rows[0]]  # equal vectors, repeated rows
    rows += [(1000 + i, [0.0] * dims) for i in range(60)] + [(None, [0.5] * dims), (None, [0.5] * dims), (None, [-0.5] * dims)]
    bad = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] + [0.1] * (dims - 1), [math.nan] + [0.1] * (dims - 1), [math.inf] + [0.1] * (dims - 1), [2.0**19] + [0.1] * (dims - 1)]
    return rows + [(2000 + i, e) for i, e in enumerate(bad)]


@pytest.mark.parametrize(("seed", "k", "rows", "leaf", "size"), [(1, 5, 64, 4, 1.0), (2, 12, 1000, 24, 1.0), (3, 7, 50, 1, 200_000.0), (4, 700, 100, 8, 1.0)])
def test_clusters(spark, seed, k, rows, leaf, size):
    data = vectors(seed, size=size)
    df = spark.createDataFrame([(i, e, 0, 0, 0, "x", True) for i, e in data], SCHEMA).repartition(3)
    out = ball_tree.with_inertia(spark, *ball_tree.cluster(df, k, 3, 8, 2, rows, leaf))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(data, k, 3, 8)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ball_tree.with_inertia(spark, *ball_tree.cluster(empty)).count() == 0
    few = spark.createDataFrame([(1, [0.25] * 64, 0, 0, 0, "x", True)], SCHEMA)
    assert [tuple(r)[:5] for r in ball_tree.with_inertia(spark, *ball_tree.cluster(few)).collect()] == [(1, 0, 0, 0, 0)]


def test_balls_give_their_sums_without_their_vectors():
    rng = np.random.default_rng(5)
    hubs = rng.integers(-4000, 4000, (4, 16))
    v = np.concatenate([h + rng.integers(-9, 10, (256, 16)) for h in hubs])
    tree, order = ball_tree.BallTree.of(v, 16)
    assert (tree.vectors == v[order]).all()
    for a, b, centre, radius, total in zip(tree.starts, tree.ends, tree.centres, tree.radii, tree.sums, strict=True):
        assert (tree.vectors[a:b].sum(0) == total).all() and (((tree.vectors[a:b] - centre) ** 2).sum(1) <= radius**2 * (1 + 1e-12)).all()
    ball, found = tree.assign(hubs)
    # whole hubs go at the second level, none vector by vector
    assert (ball >= 0).sum() <= 8 and (found == np.repeat(np.arange(4), 256)[order]).all()
    tree.vectors = np.zeros_like(tree.vectors)
    count, total = tree.partial_sums(hubs)
    assert (count == 256).all() and (total == np.stack([v[i * 256 : (i + 1) * 256].sum(0) for i in range(4)])).all()


def test_ties_and_equal_centroids_go_to_the_smaller_number():
    v = np.array([[0, 0], [2, 0], [1, 5], [-7, 3]])
    tree, order = ball_tree.BallTree.of(v, 1)
    _, found = tree.assign(np.array([[9, 9], [2, 0], [0, 0], [2, 0]]))
    assert dict(zip(order.tolist(), found.tolist(), strict=True)) == {0: 2, 1: 1, 2: 1, 3: 2}
