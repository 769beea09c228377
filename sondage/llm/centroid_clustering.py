"""Centroid clustering: k-means on integer vectors, each round pruned by Elkan's bounds.

Every vector carries an upper bound of the distance to its own centroid and a lower bound for each of the k. A centroid
that moved loosens them by as far as it moved; a distance is only calculated where neither the lower bound nor half of
the distance between the two centroids excludes the other one. Bounds are rounded outwards and exclude strictly, so a
tie is always calculated; distances themselves are exact integers. The result is that of comparing everything.

A round is one pass over the table of vectors and bounds (written after each, so nothing is computed twice after a
loss) and one grouped sum; only the k centroids, which don't grow with the table, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, fresh, materialise, narrow_batches

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1


def largest(dim: int) -> int:
    """Components below this leave every squared distance of two vectors in a 64-bit integer."""
    return int((2**62 / (4 * dim)) ** 0.5)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors with ``dim`` components, all of them finite and below ``largest``."""
    most = largest(dim)
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(scaled(v)) < F.lit(float(most - 1)))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where((F.size("v") == dim) & F.forall("v", fine))
    return kept.select("id", F.transform("v", lambda v: F.floor(scaled(v)).cast("int")).alias("x"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _above(squares: np.ndarray) -> np.ndarray:
    """A 32-bit float not below the root."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(squares: np.ndarray) -> np.ndarray:
    """A 32-bit float not above the root."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(0))


class Bounds:
    """Own centroid, upper bound and k lower bounds of a batch of vectors (int64, a row each)."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.cluster, self.upper, self.lower = x, cluster, upper, lower
        self.calculated = np.zeros(len(x), np.int32)

    @classmethod
    def unknown(cls, x: np.ndarray, k: int) -> Bounds:
        return cls(x, np.zeros(len(x), np.int32), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32))

    def moved(self, shift: np.ndarray) -> None:
        """Loosen the bounds; ``shift`` is not below what each centroid moved."""
        self.upper = np.nextafter(self.upper + shift[self.cluster], np.float32(np.inf))
        self.lower = np.maximum(np.nextafter(self.lower - shift, np.float32(-np.inf)), np.float32(0))

    def assign(self, centres: np.ndarray) -> None:
        """The nearest of ``centres`` (int64, a row each), of equal ones the first."""
        k = len(centres)
        half = np.stack([_below(squared(centres, np.broadcast_to(c, centres.shape))) for c in centres]) / np.float32(2)
        to_next = np.where(np.eye(k, dtype=bool), np.float32(np.inf), half).min(axis=1)
        own = np.full(len(self.x), -1, np.int64)  # exact squared distance to the own centroid, where it is known
        left = np.flatnonzero(~(self.upper < to_next[self.cluster]))

        def open_for(j: int, rows: np.ndarray) -> np.ndarray:
            c, u = self.cluster[rows], self.upper[rows]
            return rows[(c != j) & ~(self.lower[rows, j] > u) & ~(half[c, j] > u)]

        for j in range(k):
            rows = open_for(j, left)
            loose = rows[own[rows] < 0]
            if len(loose):
                c = self.cluster[loose]
                own[loose] = squared(self.x[loose], centres[c])
                self.upper[loose], self.lower[loose, c] = _above(own[loose]), _below(own[loose])
                self.calculated[loose] += 1
                rows = open_for(j, rows)
            if len(rows):
                d = squared(self.x[rows], np.broadcast_to(centres[j], (len(rows), centres.shape[1])))
                self.lower[rows, j] = _below(d)
                self.calculated[rows] += 1
                nearer = (d < own[rows]) | (d == own[rows]) & (j < self.cluster[rows])
                won = rows[nearer]
                self.cluster[won], own[won], self.upper[won] = j, d[nearer], _above(d[nearer])


def _matrix(lists: pa.Array, width: int, kind) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=True).reshape(-1, width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))


def _round(state: DataFrame, was: np.ndarray | None, centres: np.ndarray, last: bool) -> DataFrame:
    """Assign all vectors to ``centres``; ``was``: the centroids that the bounds of ``state`` hold for, None for none."""
    k, dim = centres.shape
    shift = None if was is None else _above(squared(centres, was)) * (centres != was).any(axis=1)
    kind = state.schema["id"].dataType.simpleString()
    out = f"id {kind}, cluster int, calculated int" + (", distance long" if last else ", x array<int>, upper float, lower array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim, np.int64)
            if shift is None:
                b = Bounds.unknown(x, k)
            else:
                b = Bounds(x, batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy().copy(), _matrix(batch.column("lower"), k, np.float32))
                b.calculated = batch.column("calculated").to_numpy().copy()
                b.moved(shift)
            b.assign(centres)
            columns = {"id": batch.column("id"), "cluster": pa.array(b.cluster), "calculated": pa.array(b.calculated)}
            if last:
                columns["distance"] = pa.array(squared(x, centres[b.cluster]))
            else:
                columns |= {"x": batch.column("x"), "upper": pa.array(b.upper), "lower": _lists(b.lower, pa.float32())}
            yield pa.RecordBatch.from_pydict(columns)

    return state.mapInArrow(run, out)


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; one without vectors stays. k rows reach the driver."""
    sums = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centres.shape[1])]
    new = centres.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centres.shape[1])]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_calculated.

    Kept are vectors of ``dim`` components that are neither null nor NaN nor infinite, nor so large (``largest`` after
    scaling) that a squared distance would leave a long. The first centroids are the ``k`` kept vectors with the
    smallest sha256 of ``seed:id``; all of them where there are fewer. Rows that repeat an id are vectors of their own,
    in order of their components where both are among the first centroids; a null id hashes as no text. Distances are
    squared and exact, of equally near centroids the smallest number wins, a centroid without vectors stays.
    ``n_calculated`` counts the distances that the bounds didn't save, k * (rounds + 1) without any. Other columns
    aren't read, whatever their names. A table without a kept vector gives no rows.
    """
    narrow_batches(vectors.sparkSession, 10_000)
    kept = integer_vectors(vectors, id_col, vec_col, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = kept.orderBy(key, "x").limit(k).collect()
    centres = np.array([r["x"] for r in start], np.int64).reshape(len(start), dim)
    if not len(centres):
        empty = kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).alias("n_calculated"))

    state, was = kept, None
    for _ in range(rounds):
        last, state = state, materialise(_round(state, was, centres, last=False), "elkan-bounds")
        if was is not None:
            discard(last)
        was, centres = centres, _means(state, centres)
    done = materialise(_round(state, was, centres, last=True), "elkan-clusters")
    if was is not None:
        discard(state)

    total = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centres.tolist()]
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    inertia = by_cluster([total.get(j, 0) for j in range(len(centres))]).cast("long")
    return done.select(F.col("id").alias(id_col), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(total.values())).cast("long").alias("inertia"), by_cluster(digest).alias("centroid_sha256"), F.col("calculated").alias(fresh(done, "n_calculated")))
