"""Exact k-means rounds with norm-of-sum bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settled, stored, tidy

K, DIM, ROUNDS, SCALE = 16, 64, 3, 64
BLOCK_ROWS = 4096
HISTORY = 64
"""Centroid sets kept. A bound whose evaluation is older is evaluated anew."""
SLACK = 1e-6
"""Bounds are 32-bit floats and are loosened by this share, which is above their rounding error."""
LIMB = 40
"""Bits of a part of a long component's sum."""
LONG = 2**63 - 1


def integer_rows(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): scale * x of the vectors with dim components, all finite; rows with a null id go."""
    x = F.col(vec_col)
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < F.lit(float("inf"))))
    return table.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double") * scale).alias("v"))


def _pack(v: np.ndarray) -> bytes:
    """Floored components as the least integer type that holds them, or as doubles, told apart by the length."""
    most = np.abs(v).max(initial=0)
    kind = np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    return v.astype(kind).tobytes()


def _fits(v: np.ndarray) -> bool:
    """Whether squared distances of such components are exact in doubles."""
    most = max((abs(int(x)) for x in (v.min(initial=0), v.max(initial=0))), default=0)
    return 4 * most * most * max(1, v.shape[1]) < 2**53


def _unpack(blob: bytes, rows: int, dim: int, plain: bool) -> np.ndarray:
    """Components as doubles, or as Python integers if they are large or plain isn't set."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[len(blob) // max(1, rows * dim)]
    v = np.frombuffer(blob, kind).reshape(rows, dim).astype(np.float64)
    if plain and _fits(v):
        return v
    return np.array([[int(x) for x in r] for r in v.tolist()], object).reshape(rows, dim)


def _limbs(n: int, parts: int) -> list[int]:
    """n as parts of LIMB bits, the last with the sign and the rest."""
    return [*((n >> LIMB * i) & ((1 << LIMB) - 1) for i in range(parts - 1)), n >> LIMB * (parts - 1)]


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """(set, centroid): how far each centroid of the last set is from where it was in each earlier one.

    That is the norm of the whole way, which is never longer than the sum of the rounds' ways, and shorter when a centroid turns back.
    """
    now = history[-1]
    return np.array([[float(sum(int(d) ** 2 for d in (now[j] - old[j]).tolist())) ** 0.5 for j in range(len(now))] for old in history])


class Assigner:
    """Assigns blocks of vectors to the last centroids of a history.

    Of each vector and centroid the last evaluated distance and the set it was evaluated with are kept. Loosened by the centroid's
    displacement since then, that is a lower bound, and for the vector's own centroid an upper one. Where all lower bounds are above the
    upper bound, nothing is evaluated. Else the own distance is, and then every centroid whose bound still fails; the nearest of all
    evaluated ones is exact, ties going to the smaller number. Large components (see _fits) are all evaluated, in Python integers.
    """

    def __init__(self, history: list[np.ndarray], since: int):
        self.since, self.now = since, since + len(history) - 1
        self.plain = all(_fits(c) for c in history)
        self.whole = history[-1]
        self.centroids = self.whole.astype(np.float64) if self.plain else self.whole
        self.moved = displacements(history) if self.plain else None

    def distances(self, x: np.ndarray, j: int) -> np.ndarray:
        """Exact squared distances of rows to one centroid."""
        apart = x - (self.whole if x.dtype == object else self.centroids)[j]
        return (apart * apart).sum(axis=1)

    def assign(self, x: np.ndarray, own: np.ndarray, far: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        """(own, number of evaluated distances); own, far and at are changed in place.

        far: last evaluated distances, at: the sets they belong to, -1 for none.
        """
        n, k = far.shape
        if x.dtype == object:
            every = [self.distances(x, j).tolist() for j in range(k)]
            own[:] = [min(range(k), key=lambda j, i=i: (every[j][i], j)) for i in range(n)]
            return own, n * k
        rows = np.arange(n)
        exact, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        stale = at < self.since
        drift = self.moved[np.where(stale, 0, at - self.since), np.arange(k)] * (1 + SLACK)
        lower = np.where(stale, -1.0, far * (1 - SLACK) - drift)
        upper = np.where(stale[rows, own], np.inf, far[rows, own] * (1 + SLACK) + drift[rows, own])

        def evaluate(which: np.ndarray) -> None:
            for j in range(k):
                if len(some := np.flatnonzero(which[:, j])):
                    exact[some, j] = self.distances(x[some], j)
            done[which] = True

        failing = lower <= upper[:, None]
        failing[rows, own] = stale[rows, own]
        open_ = failing.any(axis=1)
        first = np.zeros((n, k), bool)
        first[rows[open_], own[open_]] = True
        evaluate(first)
        upper[open_] = np.sqrt(exact[rows[open_], own[open_]]) * (1 + SLACK)
        evaluate((lower <= upper[:, None]) & ~done & open_[:, None])
        own[open_] = np.argmin(exact[open_], axis=1)
        far[done] = np.sqrt(exact[done])
        at[done] = self.now
        return own, int(np.count_nonzero(done))


def _blocks(dim: int, k: int):
    """Packs vectors into blocks where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                lists = part.column("v")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                v = np.floor(flat).reshape(part.num_rows, dim)
                blank = (np.zeros(part.num_rows, np.int16), np.zeros((part.num_rows, k), np.float32), np.full((part.num_rows, k), -1, np.int16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (part.column("vec_id").to_numpy().astype(np.int64).tobytes(), _pack(v), *(b.tobytes() for b in blank))],
                    names=["ids", "v", "own", "far", "at"],
                )

    return run


STATE = "ids binary, v binary, own binary, far binary, at binary, sums array<long>, evaluated long"


def _round(history, since: int, dim: int, parts: int):
    """Assigns each block and adds what its changed vectors take from one cluster's sums to another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history.value, since)
        k = len(assigner.centroids)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = _unpack(row["v"], len(ids), dim, assigner.plain)
                own = np.frombuffer(row["own"], np.int16).astype(np.int64)
                far, at = np.frombuffer(row["far"], np.float32).reshape(-1, k).copy(), np.frombuffer(row["at"], np.int16).reshape(-1, k).copy()
                fresh = row.get("sums") is None
                before = own.copy()
                own, evaluated = assigner.assign(x, own, far, at)
                moved = np.ones(len(own), bool) if fresh else own != before
                sums = np.zeros((k, dim + 1), object)
                for j in range(k):
                    came = moved & (own == j)
                    went = moved & (before == j) & (not fresh)
                    for some, sign in ((came, 1), (went, -1)):
                        if some.any():
                            sums[j, :dim] += sign * np.array([int(s) for s in x[some].sum(axis=0).tolist()], object)
                            sums[j, dim] += sign * int(np.count_nonzero(some))
                flat = [limb for n in sums.ravel().tolist() for limb in _limbs(int(n), parts)]
                arrays = [pa.array([b], pa.binary()) for b in (row["ids"], row["v"], own.astype(np.int16).tobytes(), far.tobytes(), at.tobytes())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([flat], pa.list_(pa.int64())), pa.array([evaluated], pa.int64())], names=[f.split()[0] for f in STATE.split(", ")])

    return run


def _last(history, since: int, dim: int):
    """The final assignment: (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history.value, since)
        k = len(assigner.centroids)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = _unpack(row["v"], len(ids), dim, assigner.plain)
                far, at = np.frombuffer(row["far"], np.float32).reshape(-1, k).copy(), np.frombuffer(row["at"], np.int16).reshape(-1, k).copy()
                own, evaluated = assigner.assign(x, np.frombuffer(row["own"], np.int16).astype(np.int64), far, at)
                distance = np.empty(len(own), object)
                for j in range(k):  # bounds may have settled a vector without a distance
                    some = own == j
                    distance[some] = assigner.distances(x[some], j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(own.astype(np.int32)), pa.array([min(LONG, int(d)) for d in distance.tolist()], pa.int64()), pa.array(np.where(np.arange(len(own)) == 0, evaluated, 0), pa.int64())],
                    names=["vec_id", "cluster", "distance", "evaluated"],
                )

    return run


def seeds(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The first k vectors by the SHA-256 of `seed:vec_id`; of rows with one id, the least vector first."""
    first = vectors.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "vec_id"), 256), "vec_id", "v").limit(k).collect()
    return np.array([[math.floor(x) for x in r["v"]] for r in first], object)


def clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", history: int = HISTORY) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluated) after so many rounds of exact k-means.

    Vectors have dim components, none null or non-finite, which become floor(scale * x); all others, and rows with a null id or with a
    component that scale takes out of the doubles' range, take no part. Centroids start as seeds() says, or as all vectors if there are fewer than k; a round assigns each vector to the nearest one
    (ties: the smaller number) and replaces each non-empty one by the floored mean.

    Vectors lie in blocks of BLOCK_ROWS rows; a round reads each block where it lies, assigns it by bounds (see Assigner), writes it
    with its new bounds and with what changed in its clusters' sums. Nothing is shuffled but these sums, k * (dim + 1) numbers a block, added
    up map-side; the centroid history goes out as a broadcast of at most HISTORY * k * dim numbers. A lost executor's blocks are read anew
    from the last round's table.

    Repeated ids are vectors of their own; ties and equal vectors are fine; components of any finite size are exact, in Python integers
    where doubles aren't; distances and sums of them beyond 64 bits are clipped; an empty table gives no rows. Other columns are ignored.
    `evaluated` is the number of exact distances that the last assignment took for the row's block, at the block's first row.
    """
    spark = table.sparkSession

    def build() -> DataFrame:
        vectors = integer_rows(table, id_col, vec_col, dim, scale)
        centroids = seeds(vectors, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, evaluated long")
        most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.count("*").alias("n")).first()
        parts = -(-(int(most["most"] + 1).bit_length() + int(most["n"]).bit_length() + 1) // LIMB)
        state = vectors.mapInArrow(_blocks(dim, len(centroids)), "ids binary, v binary, own binary, far binary, at binary")
        sets, since = [centroids], 0
        totals = np.zeros((len(centroids), dim + 1), object)
        for _ in range(rounds):
            out = spark.sparkContext.broadcast(sets)
            state = stored(state.mapInArrow(tidy(_round(out, since, dim, parts)), STATE))
            change = {r["at"]: r["n"] for r in state.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}
            flat = [sum(int(change[i * parts + p]) << LIMB * p for p in range(parts)) for i in range(totals.size)]
            totals = totals + np.array(flat, object).reshape(totals.shape)
            mean = [[t // row[dim] for t in row[:dim]] if row[dim] else old for row, old in zip(totals.tolist(), sets[-1].tolist(), strict=True)]
            sets = [*sets, np.array(mean, object)]
            if len(sets) > history:
                sets, since = sets[1:], since + 1
        placed = stored(state.select("ids", "v", "own", "far", "at").mapInArrow(tidy(_last(spark.sparkContext.broadcast(sets), since, dim)), "vec_id long, cluster int, distance long, evaluated long"))
        inertia = {r["cluster"]: int(r["inertia"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
        rows = [(j, min(LONG, inertia.get(j, 0)), min(LONG, sum(inertia.values())), hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for j, c in enumerate(sets[-1].tolist())]
        told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")

    return settled(build)
