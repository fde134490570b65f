"""Centroid clustering of integer vectors, filtered by ball trees that each partition builds of its own vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, saved_at

#: Vectors of one tree, and of a leaf at most.
TREE_ROWS, LEAF_ROWS = 8_192, 24
#: Components are below this in size, so that squared distances fit a long.
LARGEST = 1 << 27
#: Below this, sums of products of components are exact in doubles.
EXACT = 1 << 22
TREES = "vec_ids binary, no_ids binary, vectors binary, starts binary, ends binary, centres binary, radii binary, sums binary"


def split_rows(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the vectors, and where the nodes of a tree over it start and end, a node's children at 2i+1 and 2i+2.

    A node's vectors are halved by how much nearer they are to one than to the other of two vectors far apart.
    """
    order = np.arange(len(vectors))
    levels = 0
    while len(vectors) > leaf << levels:
        levels += 1
    starts, ends = np.zeros((2 << levels) - 1, np.int64), np.zeros((2 << levels) - 1, np.int64)
    ends[0] = len(vectors)
    real = vectors.astype(np.float64)
    for i in range((1 << levels) - 1):
        a, b = starts[i], ends[i]
        half = (a + b) // 2
        if b - a > 1:
            some = real[order[a:b]]
            far = some[((some - some[0]) ** 2).sum(1).argmax()]
            other = some[((some - far) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argsort(some @ (other - far), kind="stable")]
        starts[2 * i + 1], ends[2 * i + 1], starts[2 * i + 2], ends[2 * i + 2] = a, half, half, b
    return order, starts, ends


class BallTree:
    """Vectors in tree order; of each node its range, an integer centre, the radius around it and the sum of its vectors."""

    def __init__(self, vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray, centres: np.ndarray, radii: np.ndarray, sums: np.ndarray):
        self.vectors, self.starts, self.ends, self.centres, self.radii, self.sums = vectors, starts, ends, centres, radii, sums

    @classmethod
    def of(cls, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[BallTree, np.ndarray]:
        """The tree of int64 vectors, and the order in which it has them."""
        order, starts, ends = split_rows(vectors, leaf)
        v = vectors[order]
        total = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(v, 0)])
        sums = total[ends] - total[starts]
        centres = sums // np.maximum(ends - starts, 1)[:, None]
        radii = np.zeros(len(starts))
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if b > a:
                radii[i] = np.sqrt(float(((v[a:b] - centres[i]) ** 2).sum(1).max()))
        return cls(v, starts, ends, centres, radii, sums), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the centroid that its whole ball goes to or -1, and of each vector its centroid: the nearest, ties to the smaller number.

        A centroid is left out for a ball, and for the balls in it, when even the ball's nearest point is farther from it than
        the ball's farthest point from the centre's nearest centroid. Where one is left, the ball is its; leaves that keep
        several are decided vector by vector.
        """
        # of equal centroids the larger number never wins, nor would distances tell them apart
        _, first = np.unique(centroids, axis=0, return_index=True)
        numbers = np.sort(first)
        c = centroids[numbers]
        ball = np.full(len(self.starts), -1, np.int64)
        found = np.full(len(self.vectors), -1, np.int64)
        nodes, open_ = np.array([0]), np.ones((1, len(c)), bool)
        unsure = []
        while len(nodes):
            d = np.sqrt(squared(self.centres[nodes], c).astype(np.float64))
            r = self.radii[nodes]
            # sums and roots in doubles are off by far less than this
            slack = 1e-9 * (1 + d.max(1) + r)
            d[~open_] = np.inf
            open_ = d - (r + slack)[:, None] <= (d.min(1) + r)[:, None]
            whole = open_.sum(1) == 1
            full = self.ends[nodes] > self.starts[nodes]
            ball[nodes[whole & full]] = numbers[open_[whole & full].argmax(1)]
            rest = ~whole & full
            nodes, open_ = nodes[rest], open_[rest]
            leaf = 2 * nodes + 1 >= len(self.starts)
            unsure.append(nodes[leaf])
            nodes, open_ = nodes[~leaf], open_[~leaf]
            nodes, open_ = np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([open_, open_])
        for i in np.flatnonzero(ball >= 0).tolist():
            found[self.starts[i] : self.ends[i]] = ball[i]
        # exact leaves: all their vectors against all centroids
        at = np.flatnonzero(found < 0)
        for i in range(0, len(at), 4_096):
            some = at[i : i + 4_096]
            found[some] = numbers[squared(self.vectors[some], c).argmin(1)]
        return ball, found

    def partial_sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the vectors of each centroid; balls that go to one as a whole give theirs, without their vectors."""
        ball, found = self.assign(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole = np.flatnonzero(ball >= 0)
        np.add.at(count, ball[whole], (self.ends - self.starts)[whole])
        np.add.at(total, ball[whole], self.sums[whole])
        alone = np.ones(len(found), bool)
        for i in whole.tolist():
            alone[self.starts[i] : self.ends[i]] = False
        np.add.at(count, found[alone], 1)
        np.add.at(total, found[alone], self.vectors[alone])
        return count, total


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact: by products where doubles hold these, else by differences."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def usable(embeddings: DataFrame, dims: int) -> DataFrame:
    """vec_id and v, the integers floor(256 * x), of vectors with exactly dims components, none null or not finite."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / 256))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256.0)).alias("v"))


def write_trees(vectors: DataFrame, dims: int, rows: int = TREE_ROWS, leaf: int = LEAF_ROWS) -> tuple[DataFrame, str]:
    """The vectors as a written table of trees, each of `rows` to twice as many vectors of one partition (its last one fewer), and its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def tree() -> pd.DataFrame:
            ids, no_ids, v = (np.concatenate(c) for c in zip(*held, strict=True))
            t, order = BallTree.of(v, leaf)
            parts = (ids[order], no_ids[order], t.vectors.astype(np.int32), t.starts, t.ends, t.centres, t.radii, t.sums)
            return pd.DataFrame({name.split()[0]: [p.tobytes()] for name, p in zip(TREES.split(", "), parts, strict=True)})

        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                held.append((part["vec_id"].to_numpy(np.int64), part["no_id"].to_numpy(bool), np.array(part["v"].tolist(), np.int64).reshape(len(part), dims)))
                n += len(part)
                if n >= rows:
                    yield tree()
                    held, n = [], 0
        if n:
            yield tree()

    plain = vectors.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "v")
    return saved_at(plain.mapInPandas(run, TREES), "ball-trees")


def read_tree(row: tuple, dims: int) -> tuple[np.ndarray, np.ndarray, BallTree]:
    """Ids, which of them are null, and the tree of a row of write_trees' table."""
    ids, no_ids, vectors, starts, ends, centres, radii, sums = (np.frombuffer(bytes(raw), kind) for raw, kind in zip(row, ("i8", "?", "i4", "i8", "i8", "i8", "f8", "i8"), strict=True))
    shape = (-1, dims)
    return ids, no_ids, BallTree(vectors.reshape(shape).astype(np.int64), starts, ends, centres.reshape(shape), radii, sums.reshape(shape))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays.

    Each partition gives one row for each centroid and Spark adds these up; what the driver gets has the size of the centroids.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                n, s = read_tree(row, dims)[2].partial_sums(centroids)
                count += n
                total += s
        at = np.flatnonzero(count)
        if len(at):
            yield pd.DataFrame({"cluster": at.astype(np.int32), "n": count[at], "total": list(total[at])})

    parts = trees.mapInPandas(run, "cluster int, n long, total array<long>")
    # longer than a long, as many partitions' sums may be
    sums = [F.sum(F.element_at("total", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("s")).collect():
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id` (null: the word null) in this order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector of the trees."""
    k, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                ids, no_ids, tree = read_tree(row, dims)
                _, found = tree.assign(centroids)
                yield pd.DataFrame({"vec_id": ids, "no_id": no_ids, "cluster": found.astype(np.int32), "distance": ((tree.vectors - centroids[found]) ** 2).sum(1)})

    out = trees.mapInPandas(run, "vec_id long, no_id boolean, cluster int, distance long")
    return out.select(F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, rows: int = TREE_ROWS, leaf: int = LEAF_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector of embeddings (vec_id, embedding), as a written table, and the centroids.

    Vectors with another number of components, or one that is null, not finite or of 2**19 or more in size (whose squared distances
    no long holds), are left out. Repeated rows and null ids stay; fewer vectors than k are all centroids at first; equal
    distances go to the smaller number; other columns are ignored; an empty table gives an empty one and no centroids.

    The vectors are written once as trees. A round moves k rows from each partition; memory is one tree's.
    """
    vectors = usable(embeddings, dims)
    centroids = first_centroids(vectors, k, seed, dims)
    trees, at = write_trees(vectors, dims, rows, leaf)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(trees, centroids)
    out, _ = saved_at(assigned(trees, centroids), "clusters")
    remove(embeddings.sparkSession, at)
    return out, centroids


def with_inertia(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; only the clusters' sums pass through the driver."""
    from hashlib import sha256

    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(i, sums.get(i, 0), sum(sums.values()), sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts: DataFrame = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns: list[Column] = [F.col(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    return found.join(F.broadcast(facts), "cluster").select(*columns)
