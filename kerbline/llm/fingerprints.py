"""I-Match document fingerprints over randomised lexicons."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, plain_words, slabs, tidy, word_hashes

BAND = (0.001, 0.05)
"""Terms count whose share of documents is in this band: inverse document frequencies from log 20 to log 1000."""
MIN_DOCS = 2
TERM_BITS = 27
"""Terms are known by so many bits of their hash, so a lexicon is a set of 2**27 bits (16 MB), whatever the corpus. Of ten million
distinct terms 7 % share their bits with another, mostly with one too rare to matter."""
_CHUNK_BITS = 1 << 15
"""Bits of each of the pieces in which Spark builds bitmaps."""
DRAWS = (1, 2, 3, 4, 6, 8, 8, 8, 12, 12)
"""Random lexicon subsets at each level; a subset of level k holds a term with probability 2**-k. For texts of any length some level
keeps a few of their terms."""
SUBSETS = sum(DRAWS)
_LEVEL = np.repeat(np.arange(len(DRAWS)), DRAWS)
_SEED = mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = "----"
PENDING = 2_000_000
"""Distinct terms that a task holds before it hands on their counts."""


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it) of a partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        keys, at = np.unique(terms, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64)

    def out() -> pa.RecordBatch:
        keys, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["term", "docs"])

    for slab in slabs(batches, "text"):
        words, offsets = word_hashes([plain_words(t) for t in slab.column("text").to_pylist()])
        words >>= np.uint64(64 - TERM_BITS)
        held.append(np.unique(np.concatenate([np.unique(words[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), return_counts=True))
        size += len(held[-1][0])
        if size > PENDING:
            held[:] = [merged()]
            size = len(held[0][0])
            if size > PENDING // 2:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The terms of the band, counted over all documents: a bitmap of 2**TERM_BITS bits, lowest bit first, built in the cluster."""
    n_docs = docs.count()
    counts = docs.select("text").mapInArrow(tidy(_counts), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    inside = counts.filter((F.col("docs") >= max(MIN_DOCS, band[0] * n_docs)) & (F.col("docs") <= max(MIN_DOCS, band[1] * n_docs)))
    at = F.col("term") + 1  # bitmap positions start from 1
    chunks = inside.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << TERM_BITS) // 8, np.uint8)
    size = _CHUNK_BITS // 8
    got = chunks.toArrow()  # 4,096 rows of 4 kB at most
    for chunk, bits in zip(got.column("chunk").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[(chunk - 1) * size : chunk * size] = np.frombuffer(bits, np.uint8)
    return out


def prints(texts: list[str], terms: np.ndarray) -> np.ndarray:
    """SUBSETS 16-bit hashes of each text (-1: no term of the subset).

    A text's distinct terms within the lexicon, sorted; if it has none there, all of them. Each subset's hash is over those
    of them that it holds.
    """
    words, offsets = word_hashes([plain_words(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    short = words >> np.uint64(64 - TERM_BITS)
    hit = (terms[(short >> np.uint64(3)).astype(np.int64)] >> (short & np.uint64(7)).astype(np.uint8)) & 1 > 0
    use = hit | ~np.isin(np.arange(len(texts)), doc[hit])[doc]
    doc, words = doc[use], words[use]
    order = np.lexsort((words, doc))
    doc, words = doc[order], words[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])
    doc, words = doc[new], words[new]
    out = np.full((len(texts), SUBSETS), -1, np.int32)
    if not len(doc):
        return out
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rows = doc[first]
    for s in range(SUBSETS):
        draw = mix64(words ^ _SEED[s])
        inside = (draw >> np.uint64(32)) < np.uint64(1 << (32 - int(_LEVEL[s])))
        # The sorted terms are distinct, so a sum of their mixes stands for the sequence.
        digest = mix64(np.add.reduceat(np.where(inside, mix64(draw), np.uint64(0)), first))
        some = np.add.reduceat(inside, first, dtype=np.int64) > 0
        out[rows, s] = np.where(some, (digest >> np.uint64(48)).astype(np.int32), -1)
    return out


def hexed(row: np.ndarray) -> str:
    return "".join(_EMPTY if x < 0 else f"{x:04x}" for x in row.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing subsets among those in which either text has a term; 1 if neither has any."""
    either = (a >= 0) | (b >= 0)
    n = either.sum(axis=-1)
    return np.where(n == 0, 1.0, ((a == b) & either).sum(axis=-1) / np.maximum(n, 1))


def edited(text: str, after: str) -> str:
    """The text with its last half of code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in OUT.split(", ")]


def _compared(ids: list, texts: list[str], terms: np.ndarray) -> list[pa.Array]:
    """The columns of OUT for all texts but the last, which is only the one before's next."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, other = prints(texts, terms), prints(changed, terms)
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([hexed(r) for r in own[:-1]], pa.string()),
        pa.array([hexed(r) for r in other], pa.string()),
        pa.array(likeness(own[:-1], other)),
        pa.array(likeness(own[:-1], own[1:])),
    ]


_CHANGED = "the documents gave other rows when they were read again"


def _key(doc_id: int | None, text_hash: int) -> tuple[bool, int, int]:
    """The place of a document in the order: null ids come first."""
    return doc_id is not None, doc_id or 0, text_hash


def _placed(firsts: list[tuple[bool, int, int]]) -> Callable[[str, str], Column]:
    """struct(part, begins) of a document's id and hash: its part, given each part's first key, and whether that key is its own."""

    @F.arrow_udf("part int, begins boolean")
    def placed(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = [_key(*k) for k in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
        parts = [max(0, bisect_right(firsts, k) - 1) for k in keys]
        begins = [firsts[p] == k for p, k in zip(parts, keys, strict=True)]
        return pa.StructArray.from_arrays([pa.array(parts, pa.int32()), pa.array(begins, pa.bool_())], names=["part", "begins"])

    return placed


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each whole text and of its edited text (see edited), with their likeness and that to the next document's.

    A first pass counts the documents with each term and keeps the band's terms, a bitmap of fixed size (see TERM_BITS). A second
    one sorts ids and hashes only and finds the first key of each part. Then texts are dealt to those parts, once, the first of a part also to
    the end of the part before (that of the first part to the last one's): a task meets each document's next one in its sorted part, and nothing
    is written but the result.

    A null text is empty. Very long texts are hashed whole, each by itself. Repeated ids follow each other by the text's hash. Null ids come first. A single document is its own
    next. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = lexicon(texts, band)
    shared = spark.sparkContext.broadcast(terms)
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.select("doc_id", "hash").repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    firsts = sorted(_key(*r["first"]) for r in ranged.collect())  # one small row for each partition
    at, n = F.col("at"), max(1, len(firsts))
    own = F.struct(at["part"].alias("part"), F.lit(False).alias("after"))
    before = F.struct(F.pmod(at["part"] - 1, F.lit(n)).alias("part"), F.lit(True).alias("after"))
    dealt = keyed.withColumn("at", _placed(firsts)("doc_id", "hash")).select("doc_id", "hash", "text", F.inline(F.when(at["begins"], F.array(own, before)).otherwise(F.array(own))))
    sorted_parts = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "after", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far
        for slab in slabs(batches, "text"):
            rows = [*held, *zip(*(slab.column(c).to_pylist() for c in ("doc_id", "text", "part", "after")), strict=True)]
            rows = [r for r, last in zip(rows, [None, *rows], strict=False) if not (last and last[3] and r[3])]  # copies of one document begin a part
            ids, whole, part, after = zip(*rows, strict=True)
            if any(p != q and not done for p, q, done in zip(part, part[1:], after, strict=False)):
                raise ValueError(_CHANGED)
            if len(rows) > 1:
                batch = pa.RecordBatch.from_arrays(_compared(list(ids), list(whole), shared.value), names=_NAMES)
                yield batch.filter(pa.array([not done for done in after[:-1]]))
            held = rows[-1:]
        if held and not held[0][3]:
            raise ValueError(_CHANGED)

    return sorted_parts.select("doc_id", "text", "part", "after").mapInArrow(tidy(run), OUT)
