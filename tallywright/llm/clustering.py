"""Centroid clustering: rounds of nearest-centroid assignment, each found by the threshold algorithm.

For every dimension the centroids are listed in the order of that component. A vector enters each list at its own value and
walks outward from there, so that the centroids of a dimension come nearest first. Whatever a walk meets for the first
time gets its exact distance. A centroid that no walk has met yet is at least as far in every dimension as that dimension's
frontier, so the walk ends once the frontiers' squared distances sum to strictly more than the best exact distance: an equal
sum could still hide a tie with a smaller number.

Vectors stay in Spark. A round passes over them once and adds up, within each task, one row of sums a cluster; only the centroids
themselves (clusters times components numbers) come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Components beyond this have sums of squares that a long may not hold; such a vector is an error. Lists end in a value four times as far.
MAX_COMPONENT = 1 << 26
#: Vectors that walk at a time.
WALK = 2048


class Centroids:
    """The centroids, and for each dimension their values in order with the number of each."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.all = centroids
        order = np.argsort(centroids, axis=0, kind="stable")
        self.n, self.dims = centroids.shape
        # A value too far to be met stands before and after each list.
        far = np.full((1, self.dims), 4 * MAX_COMPONENT, np.int64)
        self.values = np.concatenate([-far, np.take_along_axis(centroids, order, 0), far])
        self.numbers = np.concatenate([far * 0 - 1, order, far * 0 - 1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, centroids looked at) for each row of `x`; of equally near centroids the smallest number."""
        rows, dims = len(x), np.arange(self.dims)
        best, number = np.full(rows, np.iinfo(np.int64).max), np.full(rows, self.n, np.int64)
        seen = np.zeros((rows, self.n + 1), bool)  # the last column takes what lies beyond the lists
        right = np.stack([np.searchsorted(self.values[1:-1, d], x[:, d]) for d in dims], 1) + 1
        left = right - 1
        walking = np.arange(rows)
        for _ in range(self.n):
            here = x[walking]
            below, above = here - self.values[left, dims], self.values[right, dims] - here
            down = below <= above
            met = np.where(down, self.numbers[left, dims], self.numbers[right, dims])
            frontier = np.minimum(below, above)
            left, right = left - down, right + ~down
            new = np.zeros((len(walking), self.n + 1), bool)
            new[np.arange(len(walking))[:, None], met] = True
            new &= ~seen[walking]
            seen[walking] |= new
            at, which = np.nonzero(new[:, : self.n])
            exact = ((here[at] - self.all[which]) ** 2).sum(1)
            # By vector, then distance, then number: the first of each vector is its best of this step.
            first = np.lexsort((which, exact, at))
            at, which, exact = at[first], which[first], exact[first]
            head = np.flatnonzero(np.diff(at, prepend=-1))
            at, which, exact = walking[at[head]], which[head], exact[head]
            better = (exact < best[at]) | (exact == best[at]) & (which < number[at])
            best[at[better]], number[at[better]] = exact[better], which[better]
            on = (frontier * frontier).sum(1) <= best[walking]
            walking, left, right = walking[on], left[on], right[on]
            if not len(walking):
                break
        return number, best, seen[:, : self.n].sum(1)


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dimensions` components, none null or non-finite; v has floor(scale * x) of each."""
    rows = pick(df, vec_id=id_col, vector=vector_col)
    x = F.col("vector").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    small = lambda c: F.when(F.abs(c) <= MAX_COMPONENT, c).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")))
    return rows.where((F.size("vector") == dimensions) & finite).select("vec_id", F.transform(x, lambda c: F.floor(small(c * scale))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose "seed:id" has the smallest SHA-256, in that order; ties by the vector. Rows without an id are none."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def _blocks(batch: pa.RecordBatch, dimensions: int):
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    for k in range(0, len(flat), WALK):
        yield k, flat[k : k + WALK]


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid moved to the floor of its vectors' mean; one without vectors stays."""
    k, dims = centroids.shape

    def add_up(batches):
        lists, sums, counts = Centroids(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, x in _blocks(b, dims):
                number, _, _ = lists.nearest(x)
                np.add.at(sums, number, x)
                counts += np.bincount(number, minlength=k)
        own = np.flatnonzero(counts)
        totals = [pa.array(sums[own, d]) for d in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), *totals], ["cluster", "n", *[f"s{d}" for d in range(dims)]])

    fields = ", ".join(["cluster bigint", "n bigint", *[f"s{d} bigint" for d in range(dims)]])
    parts = vectors.mapInArrow(add_up, fields)
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)])
    moved = centroids.copy()
    for r in totals.collect():  # a row a cluster
        moved[r.cluster] = [r[f"s{d}"] // r.n for d in range(dims)]
    return moved


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dims = centroids.shape[1]

    def run(batches):
        lists = Centroids(centroids)
        for b in batches:
            for at, x in _blocks(b, dims):
                number, best, _ = lists.nearest(x)
                ids = b.column(0).slice(at, len(x))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia) of each vector that is kept, the final centroids).

    Vectors that are null, of another length, or with a null or non-finite component are left out. Repeated rows stay, and each counts;
    rows without an id are assigned, but no first centroid. With fewer vectors than clusters there are fewer centroids; a table
    without any gives an empty result.
    """
    vectors = materialize(quantised(df, id_col, vector_col, dimensions), "vectors")
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        none = vectors.where("false").select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"))])
        return none, centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    assigned = materialize(assign(vectors, centroids), "assigned")
    each = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    sums = F.broadcast(each.crossJoin(F.broadcast(whole)))  # a row a cluster
    return assigned.join(sums, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
