"""Packing of token sequences by bulk-synchronous best-fit."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from .common import settled, slabs, stored, tidy

CAPACITY = 2048
END = 0
"""The id that follows each document."""
SLAB_TEXT = 8 << 20
"""Bytes of text that a task encodes together."""
KEPT_WORDS = 300_000
"""A worker keeps the ids of this many words from slab to slab."""
WORDS_AT_ONCE = 2_000
WORD_END = "</w>"
CHUNK = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
"""Fixed value: how the vocabulary's own tokenizer splits a text in lower case."""
PLAIN_BELOW = "ɐ"
"""Up to here composition leaves characters as they are and lower case depends on no other character."""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts by a word-level BPE file: distinct words once in a slab, common ones once in a worker.

    No token of such a vocabulary holds white space, so the ids of a text are those of its words one after another. Plain words (see
    PLAIN_BELOW) are split and lowered here and only their BPE is the library's; it encodes all other words as a whole.
    """

    def __init__(self, file: str):
        own = json.loads(file)
        self.whole = Tokenizer.from_str(file)
        self.whole.encode_special_tokens = True  # their names in a text are ordinary text
        merges_only = own | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(merges_only))
        self.letters = str.maketrans(_byte_letters() | {32: " "})
        vocabulary = own["model"]["vocab"]
        self.ends_word = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known = pa.array([], pa.string())
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece, which is a word of the split."""
        joined = [" ".join(pieces[i : i + WORDS_AT_ONCE]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(pieces), WORDS_AT_ONCE)]
        encoded = self.merges.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded)])
        cuts = [0, *((np.flatnonzero(self.ends_word[flat]) + 1) * 4).tolist()]
        blob = flat.tobytes()
        return {p: blob[a:b] for p, a, b in zip(pieces, cuts[:-1], cuts[1:], strict=True)}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as unsigned 32-bit integers."""
        single, split, other = {}, {}, []
        for w in words:
            if not w:
                split[w] = []
            elif (w.isascii() or max(w) < PLAIN_BELOW) and w.isprintable():
                low = w.lower()
                if low.isalpha():
                    single[w] = low
                else:
                    split[w] = CHUNK.findall(low)
            else:
                other.append(w)
        ids = self._pieces(list(set(single.values()).union(*split.values())))
        out = {w: ids[low] for w, low in single.items()}
        out.update((w, b"".join([ids[p] for p in ps])) for w, ps in split.items())
        for w, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, np.uint32).tobytes()
        return [out[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END; where each text ends)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        fresh = pc.is_null(at)
        new = distinct.filter(fresh)
        raw = self.encode_words(new.to_pylist())
        new_lengths = np.array([len(x) // 4 for x in raw], np.int64)
        new_starts = len(self.pool) + np.cumsum(new_lengths) - new_lengths
        pool = np.concatenate((self.pool, np.frombuffer(b"".join(raw), np.uint32), np.array([END], np.uint32)))
        is_new = fresh.to_numpy(zero_copy_only=False)
        starts, lengths = np.empty(len(distinct) + 1, np.int64), np.empty(len(distinct) + 1, np.int64)
        old = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[~is_new]
        for out, kept, added in ((starts, self.starts, new_starts), (lengths, self.lengths, new_lengths)):
            out[:-1][~is_new] = kept[old]
            out[:-1][is_new] = added
        starts[-1], lengths[-1] = len(pool) - 1, 1
        if len(self.known) < KEPT_WORDS:
            self.known = pa.concat_arrays([self.known, new])
            self.starts, self.lengths = np.concatenate((self.starts, new_starts)), np.concatenate((self.lengths, new_lengths))
            self.pool = pool[:-1]
        # The end of a text is one more word.
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds = bounds[1:] - bounds[0]
        order = np.insert(coded.indices.to_numpy().astype(np.int64), bounds, len(distinct))
        sizes = lengths[order]
        stop = np.cumsum(sizes)
        ids = pool[np.repeat(starts[order] - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, stop[bounds + np.arange(len(bounds))]


@lru_cache(maxsize=1)
def _encoder(file: str) -> WordEncoder:
    """One in a worker."""
    return WordEncoder(file)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces.

    A document is its text's ids and END; only one longer than capacity is cut, and only its last piece is shorter than capacity. A
    null or empty text is END alone; white space too. Repeated rows are documents of their own. Long texts are a slab of their own.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: its size doesn't depend on the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", SLAB_TEXT):
            ids, ends = _encoder(shared.value).encode(slab.column("text"))
            blob, totals = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(ends, prepend=0)
            counts = -(-totals // capacity)
            row = np.repeat(np.arange(len(ends)), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = nth * capacity
            length = np.minimum(capacity, totals[row] - start)
            first = (ends - totals)[row] + start
            crc = [zlib.crc32(blob[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [slab.column("doc_id").take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(tidy(run), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def swept(offers: DataFrame) -> DataFrame:
    """offers with `mate`: what each one is matched with, by one successor sweep.

    An offer is a row (kind, id, slot, size): kind 0 is room in a gap, kind 1 a piece. In falling size, room first, a piece takes the least
    room that holds it and that no larger piece has taken. That is how brackets match: the running number of rooms less pieces gives each
    room the level it opens and each piece the level it closes, and a piece belongs to the last room of its level. Rows are range-sorted,
    partitions count by themselves, and their totals (one row each) turn counts into levels. In a level rooms and pieces take turns, one
    of each size at most, so a level has no more rows than twice the number of sizes.
    """
    spark = offers.sparkSession
    order = [F.col("size").desc(), F.col("kind").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = offers.repartitionByRange(parts, *order, F.xxhash64("id", "slot")).sortWithinPartitions(*order)  # rows of one size may be split

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            step = 1 - 2 * batch.column("kind").to_numpy().astype(np.int64)
            level = before + np.cumsum(step)
            before = int(level[-1]) if len(level) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level, pa.int64())], names=[*batch.schema.names, "level"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in offers.schema)
    counted = stored(spread.mapInArrow(count, f"{fields}, level long").withColumn("part", F.spark_partition_id()))
    totals = counted.groupBy("part").agg(F.sum(1 - 2 * F.col("kind")).alias("step"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("before"))
    levels = counted.join(F.broadcast(starts), "part").withColumn("level", F.col("level") + F.col("before") + F.col("kind"))
    turns = W.partitionBy("level").orderBy(*order)
    other = F.struct("kind", "id", "slot", "size")
    mate = F.when(F.col("kind") == 1, F.lag(other).over(turns)).otherwise(F.lead(other).over(turns))
    return levels.withColumn("mate", mate).withColumn("mate", F.when(F.col("mate.kind") != F.col("kind"), F.col("mate"))).drop("part", "before", "level")


def _offers(state: DataFrame, longest: int, shortest: int) -> DataFrame:
    """Pieces as they are; gaps as rooms for the longest piece and one for the rest, if anything fits there."""
    rooms = F.floor(F.col("size") / longest).cast("int")
    rest = F.col("size") - rooms * longest
    sizes = F.concat(F.array_repeat(F.lit(longest).cast("long"), rooms), F.when(rest >= shortest, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    gaps = state.filter("kind = 0").withColumn("gap", F.col("size")).select("kind", "id", "gap", F.posexplode(sizes).alias("slot", "size"))
    pieces = state.filter("kind = 1").select("kind", "id", F.lit(0).cast("long").alias("gap"), F.lit(0).alias("slot"), "size")
    return gaps.unionByName(pieces)


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid, length), 0 < length <= capacity, in about as few sequences as can be.

    Items above half the capacity open a sequence each. Then sweeps (see swept) repeat until no item is left: gaps too small for any item
    are closed; as many empty sequences open as the items' total or those that fit no gap need at least; a gap offers room for several of
    the longest items; each match shortens its gap. The longest items go first, as in best-fit decreasing, and each sweep settles a
    large share of the rest: some five to seven sweeps in all. The driver sees counts by size only, 2 * capacity rows.
    """
    spark = items.sparkSession
    half = capacity // 2
    opened = items.filter(F.col("length") > half)
    sized = items.select(F.lit(1).alias("kind"), F.col("uid").alias("id"), F.col("length").alias("size"))
    state = sized.filter(F.col("size") <= half).unionByName(opened.filter(F.col("length") < capacity).select(F.lit(0).alias("kind"), F.col("uid").alias("id"), (capacity - F.col("length")).alias("size")))
    placed = opened.select("uid", "length", F.col("uid").alias("sequence_id"), F.lit(0).alias("sweep"), F.lit(0).alias("slot"))
    sweep = empty = 0
    while True:
        counts = state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
        left = {r["size"]: r["n"] for r in counts if r["kind"] == 1}
        if not left:
            break
        longest, shortest = max(left), min(left)
        gaps = {r["size"]: r["n"] for r in counts if r["kind"] == 0 and r["size"] >= shortest}
        widest = max(gaps, default=0)
        missing = sum(s * n for s, n in left.items()) - sum(s * n for s, n in gaps.items())
        unfit = sum(s * n for s, n in left.items() if s > widest)
        more = max(0, math.ceil(max(missing, unfit) / capacity))
        fresh = spark.range(empty, empty + more).select(F.lit(0).alias("kind"), (-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"))
        empty, sweep = empty + more, sweep + 1
        usable = state.filter((F.col("kind") == 1) | (F.col("size") >= shortest)).unionByName(fresh)
        done = stored(swept(_offers(usable, longest, shortest)))
        taken = done.filter("kind = 1 and mate is not null")
        placed = placed.unionByName(taken.select(F.col("id").alias("uid"), F.col("size").alias("length"), F.col("mate.id").alias("sequence_id"), F.lit(sweep).alias("sweep"), F.col("mate.slot").alias("slot")))
        shrunk = done.filter("kind = 0").groupBy("kind", "id").agg((F.max("gap") - F.sum(F.coalesce("mate.size", F.lit(0)))).alias("size")).filter("size > 0")
        state = done.filter("kind = 1 and mate is null").select("kind", "id", "size").unionByName(shrunk.select("kind", "id", "size"))
    inside = W.partitionBy("sequence_id").orderBy("sweep", "slot").rowsBetween(W.unboundedPreceding, W.currentRow)  # capacity rows at most
    return placed.select("uid", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, stored, with a number of its own for each in `uid`."""
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece of each document (see token_pieces) and its place.

    Places in a sequence are gapless from 0, sequences hold at most capacity tokens. Texts don't move between tasks; pieces do, as small
    rows. Nulls, empty and very long texts and repeated rows are as token_pieces says; documents of equal length are interchangeable; an
    empty table gives no rows. Other columns are ignored.
    """

    def build() -> DataFrame:
        pieces = _numbered(token_pieces(docs, path, capacity, id_col, text_col))
        places = best_fit(pieces.select("uid", "length"), capacity)
        return pieces.join(places, "uid").drop("uid")

    return settled(build)


def fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, tokens, least): how many sequences a packing has, its tokens, and the least number of sequences that could hold them."""
    tokens = F.sum("length")
    return pieces.agg(F.count_distinct("sequence_id").alias("sequences"), tokens.alias("tokens"), F.ceil(tokens / capacity).alias("least"))
