"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

LISTS = 4
"""Lists of partial scores in the sense of the threshold method: runs of rotated dimensions with equal shares of the energy."""
ROTATION_ROWS, ROTATION_DIM = 4096, 1024
"""Vectors, those of the least hash, whose principal axes the lists follow, and their longest length: the rotation is 8 MB at most. It only
decides how early entries fall below the cutoff: results don't depend on it. Longer vectors keep their own axes."""
FEW = 0.02
"""Share of a strip's entries from which on their scores come from one matrix product and not one by one."""
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BOUNDED = 2.0**480
"""Blocks with components from here on have norms or products that doubles don't hold: all their scores are computed, in Python integers."""
CLIP = 2**63 - 1
_COMPLEMENT = str.maketrans("0123456789", "9876543210")
STRIP = 128
"""Queries scored at once inside a task: STRIP x BLOCK_ROWS partial scores of each list in memory."""


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): scale * x of each component as double; packing floors them. Rows with a null, non-finite or missing component go."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < F.lit(float("inf"))))
    return table.filter(F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double") * scale).alias("v")
    )


def _packed(rows: DataFrame, size: int, extra: bool = False) -> DataFrame:
    """Blocks of at most size vectors of one length each, packed where they lie: (block, dim, ids, v[, cutoff])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            ids = np.array([p[0] for p in part], np.int64)
            cols = [pa.array([int(ids[0]) * 31 + len(ids)], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary())]
            cols.append(pa.array([np.floor(np.array([p[1] for p in part], np.float64)).tobytes()], pa.binary()))
            if extra:
                cols.append(pa.array([np.array([p[2] for p in part], np.float64).tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=["block", "dim", "ids", "v", *["cutoff"] * extra])

        for batch in batches:
            cutoffs = batch.column(2).to_pylist() if extra else [0] * batch.num_rows
            vectors = batch.column(1)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, (vec_id, cutoff) in enumerate(zip(batch.column(0).to_pylist(), cutoffs, strict=True)):
                vector = flat[offsets[i] : offsets[i + 1]].copy()
                held.setdefault(len(vector), []).append((vec_id, vector, cutoff))
                if len(held[len(vector)]) == size:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "block long, dim int, ids binary, v binary" + ", cutoff binary" * extra)


def rotation(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(axes, cuts between lists) for the sampled vectors' lengths: principal axes by falling energy."""
    moderate = F.forall("v", lambda c: F.abs(c) < BOUNDED)
    sample = vectors.filter(F.size("v").between(1, ROTATION_DIM) & moderate).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(ROTATION_ROWS).select("v").toArrow().column("v").to_pylist()
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim])
        x /= max(1.0, np.abs(x).max())  # against overflow
        energy, axes = np.linalg.eigh(x.T @ x)
        share = np.cumsum(np.maximum(energy[::-1], 0) + 1e-12)
        inner = 1 + np.searchsorted(share, share[-1] * np.arange(1, LISTS) / LISTS)
        out[dim] = axes[:, ::-1].copy(), np.concatenate(([0], np.minimum(inner, dim), [dim]))
    return out


def _whole(m: np.ndarray) -> np.ndarray:
    """The components as Python integers."""
    return np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)


def _sort_key(score: int) -> str | None:
    """Text that orders scores which don't fit 64 bits, and null for those that do."""
    if abs(score) < CLIP:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(_COMPLEMENT)


class _Pair:
    """A block of queries and a block of candidates: exact scores, and partial scores in rotated dimensions with their bounds."""

    def __init__(self, row: dict, axes: dict[int, tuple[np.ndarray, np.ndarray]]):
        dim = row["dim"]
        self.q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q, c = np.frombuffer(row["q_v"]).reshape(len(self.q_ids), dim), np.frombuffer(row["v"]).reshape(len(c_ids), dim)
        self.cutoffs = np.frombuffer(row["cutoff"]) if "cutoff" in row else np.full(len(self.q_ids), -np.inf)
        order = np.argsort(c_ids, kind="stable")
        self.c_ids, c = c_ids[order], c[order]
        largest = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
        self.bounded = bool(largest < BOUNDED)
        if not self.bounded:
            self.q, self.c = _whole(q), _whole(c)
            return
        turn, self.cuts = axes.get(dim) or (None, np.linspace(0, dim, LISTS + 1).astype(int))
        # Bounds in floating point are loosened by more than their error.
        self.loose = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=0))
        self.rq, self.rc = (q, c) if turn is None else (q @ turn, c @ turn)
        # What the lists after each one can add at most, by the norms of both sides.
        self.rest = [tuple(np.linalg.norm(x[:, n:], axis=1) for x in (self.rq, self.rc)) for n in self.cuts[1:]]
        bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(dim, 1)
        if bound < 2**53:
            kind = np.float32 if bound < 2**24 else np.float64
            self.q, self.c = q.astype(kind), c.astype(kind)
        else:
            self.q, self.c = _whole(q), _whole(c)

    def partial(self, part: slice, n: int) -> np.ndarray:
        a, b = self.cuts[n : n + 2]
        return self.rq[part, a:b] @ self.rc[:, a:b].T

    def exact(self, part: slice, at_q: np.ndarray, at_c: np.ndarray) -> np.ndarray:
        """Exact scores of the entries, sums being exact in the type chosen."""
        q = self.q[part]
        if q.dtype != object and len(at_q) > FEW * len(q) * len(self.c):
            return (q @ self.c.T)[at_q, at_c]
        out = np.zeros(len(at_q), q.dtype)
        for i in range(0, len(at_q), 1 << 16):
            out[i : i + (1 << 16)] = (q[at_q[i : i + (1 << 16)]] * self.c[at_c[i : i + (1 << 16)]]).sum(axis=1)
        return out

    def strips(self) -> Iterator[slice]:
        for s in range(0, len(self.q_ids), STRIP):
            yield slice(s, min(s + STRIP, len(self.q_ids)))


def _local_bounds(k: int, axes):
    """Phase 1: each block's k best of one list, in turn another one for each block; their exact scores are the block's score list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, axes.value)
                if not pair.bounded:
                    continue  # a cutoff only has to be safe
                n_named = min(k + 1, len(pair.c_ids))  # one more, as the own row may be among them
                for part in pair.strips():
                    ids = pair.q_ids[part]
                    named = np.argpartition(pair.partial(part, int(row["bucket"]) % LISTS), len(pair.c_ids) - n_named, axis=1)[:, -n_named:]
                    at_q = np.repeat(np.arange(len(ids)), n_named)
                    scores = pair.exact(part, at_q, named.ravel())
                    if scores.dtype == object:  # as doubles that aren't above them
                        scores = np.nextafter(scores.astype(np.float64), -np.inf)
                    scores = scores.astype(np.float64).reshape(named.shape)
                    scores[pair.c_ids[named] == ids[:, None]] = -np.inf
                    scores = -np.sort(-scores, axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r[np.isfinite(r)].tolist() for r in scores], pa.list_(pa.float64()))], names=["query_id", "scores"])

    return run


def sufficient_entries(pair: _Pair, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of the entries that can still reach their query's cutoff after the lists but the last."""
    ids = pair.q_ids[part]
    enough = pair.c_ids[None, :] != ids[:, None]
    if not pair.bounded:
        return np.nonzero(enough)
    cutoffs = pair.cutoffs[part] - pair.loose[part]
    total = np.zeros(enough.shape)
    for n in range(LISTS - 1):
        total += pair.partial(part, n)
        rest_q, rest_c = pair.rest[n]
        # The uniform threshold of list n: below it an entry can't reach the cutoff, even if the lists after it agree wholly.
        enough &= total >= cutoffs[:, None] - rest_q[part, None] * rest_c[None, :]
        if np.count_nonzero(enough) <= FEW * enough.size:
            break
    return np.nonzero(enough)


def _sufficient(k: int, axes):
    """Phases 2 and 3: entries that can reach the cutoff, list by list, then the exact scores of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, axes.value)
                for part in pair.strips():
                    ids, c_ids = pair.q_ids[part], pair.c_ids
                    at_q, at_c = sufficient_entries(pair, part)
                    score = pair.exact(part, at_q, at_c)
                    cutoffs = pair.cutoffs[part][at_q]
                    reach = score >= cutoffs if score.dtype != object else np.array([a >= b for a, b in zip(score.tolist(), cutoffs.tolist(), strict=True)], bool)
                    at_q, at_c, score = at_q[reach], at_c[reach], score[reach]
                    if score.dtype == object:
                        order = np.array(sorted(range(len(score)), key=lambda i: (at_q[i], -score[i], c_ids[at_c[i]])), int)
                    else:
                        order = np.lexsort((c_ids[at_c], -score.astype(np.float64), at_q))
                    at_q, at_c, score = at_q[order], at_c[order], score[order]
                    nth = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
                    top = nth < k  # no more than k of a block can be among the k best
                    whole = [int(s) for s in score[top].tolist()]
                    clipped = pa.array([max(-CLIP - 1, min(CLIP, s)) for s in whole], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at_q[top]]), pa.array(c_ids[at_c[top]]), clipped, pa.array(map(_sort_key, whole), pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    return run


def exact_top_k(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, its k highest integer inner products.

    Candidates are all other ids; ties go to the smaller id; all are returned if there are fewer than k.

    Vectors are rotated to their principal axes, whose range is cut into LISTS lists of equal energy, and rows into blocks. Phase 1: each
    block takes the top k of one list, in turn another one for each block, and scores what it names exactly; the k-th best of all blocks'
    scores is a safe cutoff, as that many candidates reach it. Phase 2: the cutoff goes out with each query; blocks add list after list and
    keep the entries that can still reach it, by the norms of what is left. Phase 3: those entries get exact scores, and what reaches the
    cutoff meets in a top-k window.

    Every pair of a block of queries and a block of rows is a row of an equi-join on the row block's bucket: vectors
    move packed, BLOCK_ROWS and QUERY_ROWS bound what a task holds, and nothing is broadcast.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of
    different length aren't compared. If an id repeats, its rows are separate candidates, and the query is the least of its
    vectors. Scores beyond 64 bits are ranked by their whole value and shown
    clipped; components of any finite size are exact (scale * x, if that is finite: else the vector takes no part). Ties and empty tables are fine. Other columns are ignored.
    """
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vec_col)
    blocks = stored(_packed(vectors, BLOCK_ROWS))
    n_blocks = max(1, blocks.count())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = stored(vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_queries = queries.count()
    parts = max(1, math.ceil(n_queries / QUERY_ROWS))

    axes = spark.sparkContext.broadcast(rotation(vectors))

    def pairs(q: DataFrame) -> DataFrame:
        q = q.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumnsRenamed({"ids": "q_ids", "v": "q_v"}).drop("block")
        c = blocks.withColumn("bucket", F.pmod(F.xxhash64("block", "ids"), F.lit(n_blocks)).cast("int"))
        return q.join(c, ["bucket", "dim"]).drop("block").repartition(max(tasks, min(n_blocks * parts, 4 * tasks)))

    local = pairs(_packed(queries.repartition(parts), QUERY_ROWS)).mapInArrow(_local_bounds(k, axes), "query_id long, scores array<double>")
    best = W.partitionBy("query_id").orderBy(F.col("bound").desc())
    lists = local.select("query_id", F.explode("scores").alias("bound")).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
    cutoffs = lists.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("bound")).alias("cutoff"))
    asked = queries.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    found = pairs(_packed(asked.repartition(parts), QUERY_ROWS, extra=True)).mapInArrow(_sufficient(k, axes), "query_id long, vec_id long, score long, beyond string")
    last = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
