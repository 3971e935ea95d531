"""MinHash near-dedup by a multi-index Hamming join, with links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import star_roots
from .common import mix64, settled, slabs, stored, tidy, word_hashes

WORDS = 5
CHUNKS, CHUNK_SYMBOLS, ERRORS = 10, 4, 1
"""A signature has CHUNKS x CHUNK_SYMBOLS symbols of 16 bits. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
symbols differ in at most ERRORS of some chunk's. At similarity 0.75 a chunk has more errors with probability 0.262, all ten
of them with 1.5e-6."""
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
_SEED = mix64(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BLOCK = 512
BLOCK_BYTES = 16 << 20
"""Sets of a bucket compared at once, by number and by size: bounds of what a task holds of a bucket, not of the bucket. A larger set is a
block of its own, more or less."""
BROADCAST_IDS = 1_000_000
"""Ids up to this number are broadcast (8 MB); more are joined by a shuffle."""


def shingle_sets(texts: Iterable[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (module contract: op7)."""
    lower = [(t or "").encode().lower() for t in texts]  # bytes.lower changes A-Z only
    words, offsets = word_hashes(lower)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:  # one sequence, told from others by its length
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = h * np.uint64(0x9FB21C651E98DF25) + w
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def index_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Each non-empty set's index keys: CHUNKS x CHUNK_SYMBOLS of them, one for each chunk and symbol left out.

    A symbol is 16 bits of the least value of the set under one hash function. Leaving out each symbol in turn enumerates
    the allowed error of a chunk: signatures that agree there but for one symbol share a key.
    """
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    symbols = np.empty((len(sets), SYMBOLS), np.int64)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ _SEED[k]) * _SEED[SYMBOLS + k], starts)
        symbols[:, k] = (mix64(least) >> np.uint64(48)).astype(np.int64)
    keys = []
    for c in range(CHUNKS):
        own = symbols[:, c * CHUNK_SYMBOLS : (c + 1) * CHUNK_SYMBOLS]
        for left_out in range(CHUNK_SYMBOLS):
            key = np.full(len(sets), c * CHUNK_SYMBOLS + left_out, np.int64)
            for j in range(CHUNK_SYMBOLS):
                if j != left_out:
                    key = key << 16 | own[:, j]
            keys.append(key)
    return np.stack(keys, axis=1)


def _digests(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A 128-bit digest of each set: sums of two mixes of its elements."""
    return tuple([int(mix64(s ^ np.uint64(k)).sum().astype(np.int64)) for s in sets] for k in (1, 2))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, "text"):
        sets = shingle_sets(slab.column("text").to_pylist())
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            for i, row in zip(full, index_keys([sets[i] for i in full]), strict=True):
                keys[i] = row
        a, b = _digests(sets)
        yield pa.RecordBatch.from_arrays(
            [slab.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, "text"):
        sets = shingle_sets(slab.column("text").to_pylist())
        a, b = _digests(sets)
        columns = [slab.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], a, b)), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "set_a", "set_b", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps (a, b) if their whole sets overlap enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 75 * (len(x) + len(y) - common))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _linked_blocks(minor: pa.Table, every: pa.Table) -> pa.Table:
    """Links between a block of a bucket's minor documents and a block of all its documents, by matrix products."""
    a_id, b_id = (t.column("rep").to_numpy() for t in (minor, every))
    a_class, b_class = (t.column("class").to_numpy() for t in (minor, every))
    a_set, b_set = ([np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()] for t in (minor, every))
    empty = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    if not len(a_id) or not len(b_id):
        return empty
    a_flat, b_flat = np.concatenate(a_set), np.concatenate(b_set)
    shared = np.intersect1d(a_flat, b_flat)
    a_n, b_n = (np.array([len(s) for s in sets]) for sets in (a_set, b_set))
    a_row, b_row = np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)
    common = np.zeros((len(a_id), len(b_id)), np.float32)  # counts, exact up to 2**24 shingles
    sides = []
    for flat, row in ((a_flat, a_row), (b_flat, b_row)):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row[hit][order]))
    for start in range(0, len(shared), 4096):
        strips = []
        for (at, row), n in zip(sides, (len(a_id), len(b_id)), strict=True):
            lo, hi = np.searchsorted(at, (start, start + 4096))
            m = np.zeros((n, min(4096, len(shared) - start)), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            strips.append(m)
        common += strips[0] @ strips[1].T
    link = (100 * common >= 75 * (a_n[:, None] + b_n[None, :] - common)) & (a_class[:, None] != b_class[None, :])
    x, y = np.nonzero(link)
    if not len(x):
        return empty
    # One link to each class is as good as all of them.
    _, first = np.unique(np.stack((x, b_class[y])), axis=1, return_index=True)
    return pa.table({"x": a_id[x[first]], "y": b_id[y[first]]})


def _class_roots(signed: DataFrame, classes: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the classes' representatives that aren't their component's least id: steps 2 and 3 of near_duplicates."""
    reps = signed.filter("n_shingles > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b", "n_shingles"])
    keyed = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key")).distinct()
    # The order of documents that choose a bucket's first is another one for each chunk.
    chunk = F.floor(F.shiftright("key", 48) / CHUNK_SYMBOLS)
    # Stored tables leave nothing but exchanges under the joins, so that hot keys can be split.
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep", chunk).alias("turn"), "rep")).alias("first")).filter("n > 1"))
    buckets = stored(keyed.join(sizes.select("key", "n", F.col("first.rep").alias("first")), "key"))
    pairs = stored(buckets.filter("rep != first").select(F.greatest("rep", "first").alias("x"), F.least("rep", "first").alias("y")).distinct())
    ids = stored(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    rows = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    # An id that occurs with several texts keeps all their sets.
    sets = stored(rows.mapInArrow(tidy(_sets), "doc_id long, size long, set_a long, set_b long, shingles binary").dropDuplicates(["doc_id", "set_a", "set_b"]).drop("set_a", "set_b"))

    def of(side: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))

    compared = pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "set_x", "set_y").mapInArrow(tidy(_linked), "x long, y long")
    # Classes that share an id are linked by it.
    shared = own.groupBy("doc_id").agg(F.min("rep").alias("y"), F.max("rep").alias("x")).filter("x > y").select("doc_id", "y")
    links = stored(compared.union(own.join(shared, "doc_id").filter("rep > y").select(F.col("rep").alias("x"), "y")))
    roots = star_roots(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    # Buckets of two have had their only comparison.
    open_ = stored(buckets.filter("n > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("class")))
    members = stored(open_.groupBy("key", "class").agg(F.count("*").alias("m")))
    split = stored(members.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("m", "class")).alias("major")).filter("classes > 1").select("key", F.col("major.class").alias("major")))
    mixed = stored(open_.join(split, "key").join(sets.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("size").alias("size")), "rep"))
    apart = F.col("class") != F.col("major")

    def blocks(rows: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.sum(rows) / BLOCK), F.ceil(F.sum(size) * 8 / BLOCK_BYTES)).cast("int")

    plan = stored(mixed.groupBy("key").agg(blocks(F.when(apart, 1).otherwise(0), F.when(apart, F.col("size")).otherwise(0)).alias("minor_blocks"), blocks(F.lit(1), F.col("size")).alias("all_blocks")))
    rows = mixed.drop("size").join(plan, "key").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def own_block(n: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")

    def each_block(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    fields = [F.col(c).alias(c) for c in ("key", "rep", "class", "shingles")]  # new columns, as both sides come from rows
    minor = rows.filter(apart).select(*fields, own_block("minor_blocks").alias("i"), each_block("all_blocks").alias("j"))
    every = rows.select(*fields, each_block("minor_blocks").alias("i"), own_block("all_blocks").alias("j"))
    more = minor.groupBy("key", "i", "j").cogroup(every.groupBy("key", "i", "j")).applyInArrow(_linked_blocks, "x long, y long")
    more = stored(more.distinct())
    if more.limit(1).count():
        return star_roots(links.union(more).select(F.col("x").alias("u"), F.col("y").alias("v")))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Words are runs of characters other than space and \\t to \\r, with A-Z lowered; a document's set holds its distinct 5-word
    shingles, or all its words as one if it has fewer. Documents are linked if 100 * intersection >= 75 * union;
    component_id is the least doc_id that links reach, kept tells that it is the document's own.

    1. Signatures (see index_keys). Documents with equal sets form a class that its least id stands for, so copies end here.
    2. Documents that share an index key form a bucket. In each bucket all are compared with one document, another in each
       chunk's buckets; that finds most links in large groups with work in proportion to the bucket.
    3. Buckets that still hold several components: documents outside the bucket's largest component are compared with all
       others of the bucket, in blocks. Then every pair that shares a key is linked, in one component, or compared.

    Comparisons are of whole sets of 64-bit shingle hashes. No bucket is capped, gathered in one task or written out as pairs.

    Null or empty texts have no shingles, their own component, and are kept. Very long texts are hashed whole, each by itself. Rows with one
    id are one node, also if their texts differ; a null id links nothing and is kept, its component_id is null. An empty table gives no
    rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(tidy(_signatures), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"))

    def components() -> DataFrame:
        classes = stored(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
        own = stored(signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", "rep"))
        roots = stored(_class_roots(signed, classes, own.filter("doc_id is not null and rep is not null"), texts))
        of_class = own.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")))
        return of_class.select("doc_id", "n_shingles", "component_id")

    out = settled(components)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates keeps, with their own columns.

    Of rows with one id, the one with the least text hash stays (equal rows: one of them); rows with a null id all stay. Null and empty texts
    and very long ones are no exception; an empty table gives none. Extra columns may have any name and type.
    """
    clash = {c: f"docs_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    safe = docs.withColumnsRenamed(clash)
    kept = settled(lambda: near_duplicates(docs.select("doc_id", "text")).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct())
    few = kept.count() <= BROADCAST_IDS
    rows = safe.join(F.broadcast(kept) if few else kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    repeated = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    single = rows.join(repeated, "doc_id", "left_anti")
    several = rows.join(repeated, "doc_id", "left_semi").withColumn("turn", F.xxhash64("text"))
    first = several.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(c).alias(c) for c in safe.columns)), "turn").alias("row")).select("row.*")
    out = single.select(*safe.columns).union(first).union(safe.filter("doc_id is null"))
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
