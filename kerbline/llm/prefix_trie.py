"""Prefix trie of conversations by whole-sequence collapse."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settled, stored, tidy
from .mixing import word_count

FAMILY, HEADS = 20, 4
"""Conversations of a family share its first one's beginning: up to HEADS - 1 turns."""
PIECE_IDS = 4096
"""Ids written out together, so that the list of a large group travels as few rows."""
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of each turn: a digest of its role and text instead of them. Rows without conv_id go."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # The role's length tells where it ends.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.md5(whole.cast("binary")).alias("digest"), word_count(text).alias("words")
    )


def taken_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def in_order(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows, stored, range-sorted by key and order, with `part`: a number of the partition they are in."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, F.col(key), *order).withColumn("part", F.spark_partition_id()))


def carried(rows: DataFrame, key: str, *totals: tuple[Callable[[Column | str], Column], Column]) -> DataFrame:
    """(key, part, total_0, ...): what the parts before hold of each key that is in more parts than one.

    A total is an aggregate function and what it takes. Two rows a part at most are of such keys: other keys of a part lie inside it.
    """
    each = rows.groupBy(key, "part").agg(*(f(column).alias(f"total_{i}") for i, (f, column) in enumerate(totals)))
    broken = each.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias(key))
    before = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    some = each.join(F.broadcast(broken), ["part", key], "left_semi")
    return some.select(key, "part", *(f(f"total_{i}").over(before).alias(f"total_{i}") for i, (f, _) in enumerate(totals))).filter(F.col("total_0").isNotNull())


def _placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, digest, words): each turn's place in its conversation from 1; ties in turn by the digest."""
    rows = in_order(turn_rows(conversations), "conv_id", F.col("turn").asc_nulls_first(), F.col("digest"))
    here = W.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    before = carried(rows, "conv_id", (F.sum, F.lit(1)))
    numbered = rows.withColumn("nth", F.row_number().over(here)).join(F.broadcast(before), ["part", "conv_id"], "left")
    return numbered.select("conv_id", "part", (F.col("nth") + F.coalesce("total_0", F.lit(0))).alias("pos"), "digest", "words")


def _marks(depth: Column, digest: Column) -> list[Column]:
    """Two words of 64 bits for a turn at a depth; a sequence's key holds the exclusive or of its turns'."""
    return [F.xxhash64(F.lit(n), depth, digest).alias(f"mark_{n}") for n in (1, 2)]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own turns, conversations): stored tables of the rebuilt conversations.

    Own turns: (conv_id, part, depth, mark_1, mark_2, words). Conversations, also turnless: (conv_id, heads, n, key_1, key_2), where heads
    are the turns taken from the family's first, with marks and words, n is the number of turns and the keys are of the whole sequence.
    """
    placed = stored(_placed(conversations))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    beginnings = first.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("depth"), *_marks(F.col("pos").cast("int"), F.col("digest")), "words"))).alias("beginning"))
    spans = placed.groupBy("conv_id", "part").agg(F.max("pos").alias("last")).withColumns({"family": family, "taken": taken_turns(F.col("conv_id"))})
    spans = spans.join(beginnings, "family", "left").withColumn("heads", F.slice(F.coalesce("beginning", F.array().cast("array<struct<depth:int,mark_1:bigint,mark_2:bigint,words:bigint>>")), F.lit(1), F.col("taken")))
    spans = stored(spans.select("conv_id", "part", "taken", "heads"))
    depth = (F.col("pos") - F.col("taken") + F.size("heads")).cast("int")
    own = placed.join(spans, ["conv_id", "part"]).filter(F.col("pos") > F.col("taken"))
    own = stored(own.select("conv_id", "part", depth.alias("depth"), *_marks(depth, F.col("digest")), "words"))
    ends = own.groupBy("conv_id").agg(F.max("depth").alias("deepest"), F.bit_xor("mark_1").alias("own_1"), F.bit_xor("mark_2").alias("own_2"))
    heads = spans.groupBy("conv_id").agg(F.first("heads").alias("heads"))

    def key(n: int) -> Column:
        of_heads = F.aggregate("heads", F.lit(0).cast("long"), lambda x, turn: x.bitwiseXOR(turn[f"mark_{n}"]))
        return of_heads.bitwiseXOR(F.coalesce(F.col(f"own_{n}"), F.lit(0))).alias(f"key_{n}")

    convs = heads.join(ends, "conv_id", "left")
    return own, stored(convs.select("conv_id", "heads", F.coalesce("deepest", F.size("heads")).alias("n"), key(1), key(2)))


NODE = ["depth", "key_1", "key_2"]


def _prefixes(own: DataFrame, firsts: DataFrame) -> DataFrame:
    """(conv_id, depth, keys, up_1, up_2, before, words) of every prefix of the conversations in firsts: with the parent's keys, and the words before the last turn."""
    none = F.lit(0).cast("long")
    start = F.aggregate("heads", F.struct(none.alias("a"), none.alias("b"), none.alias("w")), lambda x, t: F.struct(x["a"].bitwiseXOR(t["mark_1"]).alias("a"), x["b"].bitwiseXOR(t["mark_2"]).alias("b"), (x["w"] + t["words"]).alias("w")))
    mine = stored(own.join(firsts.select("conv_id", start.alias("start")), "conv_id"))
    here = W.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = carried(mine, "conv_id", (F.bit_xor, F.col("mark_1")), (F.bit_xor, F.col("mark_2")), (F.sum, F.col("words")))
    running = mine.withColumns({"run_1": F.bit_xor("mark_1").over(here), "run_2": F.bit_xor("mark_2").over(here), "run_words": F.sum("words").over(here)})
    running = running.join(F.broadcast(before), ["part", "conv_id"], "left")
    key_1 = F.col("run_1").bitwiseXOR(F.coalesce("total_0", none)).bitwiseXOR(F.col("start.a"))
    key_2 = F.col("run_2").bitwiseXOR(F.coalesce("total_1", none)).bitwiseXOR(F.col("start.b"))
    upto = F.col("run_words") + F.coalesce("total_2", none) + F.col("start.w")
    later = running.select("conv_id", "depth", key_1.alias("key_1"), key_2.alias("key_2"), "mark_1", "mark_2", (upto - F.col("words")).alias("before"), "words")
    turn = F.col("turn")
    some = firsts.select("conv_id", "heads", F.explode("heads").alias("turn"))
    upto_turn = F.filter("heads", lambda t: t["depth"] <= F.col("turn.depth"))

    def folded(n: int) -> Column:
        return F.aggregate(upto_turn, none, lambda x, t: x.bitwiseXOR(t[f"mark_{n}"])).alias(f"key_{n}")

    words = F.aggregate(upto_turn, none, lambda x, t: x + t["words"])
    early = some.select("conv_id", turn["depth"].alias("depth"), folded(1), folded(2), turn["mark_1"].alias("mark_1"), turn["mark_2"].alias("mark_2"), (words - turn["words"]).alias("before"), turn["words"].alias("words"))
    rows = later.unionByName(early).withColumns({"up_1": F.col("key_1").bitwiseXOR(F.col("mark_1")), "up_2": F.col("key_2").bitwiseXOR(F.col("mark_2"))}).drop("mark_1", "mark_2")
    root = firsts.select("conv_id", F.lit(0).alias("depth"), none.alias("key_1"), none.alias("key_2"), none.alias("before"), none.alias("words"), none.alias("up_1"), none.alias("up_2"))
    return rows.unionByName(root)


def end_lists(members: DataFrame) -> DataFrame:
    """(keys, ends_sha256): of each group of conv_ids, in order, joined by commas.

    Ids are range-sorted, so a large group is spread; each partition writes its ids out PIECE_IDS at a time, and the task that a group ends
    in streams these pieces through the hash, which can only be computed in order, without holding them.
    """
    spread = members.select(*NODE, "conv_id").repartitionByRange(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*NODE, "conv_id")]
            out: list[tuple] = []
            for *key, conv_id in zip(*columns, strict=True):
                if out and out[-1][0] == key and len(out[-1][2]) < PIECE_IDS:
                    out[-1][2].append(str(conv_id))
                else:
                    out.append((key, conv_id, [str(conv_id)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, *_ in out], pa.int32()), *(pa.array([k[i] for k, *_ in out], pa.int64()) for i in (1, 2)), pa.array([c for _, c, _ in out], pa.int64()), pa.array([",".join(x) for *_, x in out])],
                names=[*NODE, "conv_id", "ids"],
            )

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == now:
                    running.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, running.hexdigest()))
                    now, running = key, hashlib.sha256(ids.encode())
            yield _ended(out)
        if now:
            yield _ended([(*now, running.hexdigest())])

    pieces = spread.mapInArrow(tidy(write), "depth int, key_1 long, key_2 long, conv_id long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(hash_, "depth int, key_1 long, key_2 long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie.

    conversations: (conv_id, turn, role, text). A conversation c takes the first crc32(c) % 4 turns of conversation c - c % 20 in place of
    its own first ones. A node is a distinct sequence of first turns; conv_id is its least member.

    1. Turns become digests. They are range-sorted, so that one conversation may be spread over tasks; its places and prefix keys come
       from running values inside a partition and from what the partitions before hold.
    2. Equal rebuilt conversations collapse to one weighted sequence, which its least conv_id stands for, and an end list.
    3. Sequences that are proper prefixes of others go by an anti-join: the rest are the leaves.
    4. Weighted prefixes are summed up. saved_tokens of a node is the sum of n_convs * words below it less that of words below it. The
       first is a sum over sequences of weight * words from here on. For the second each node below counts for the one sequence that it
       is named after; a sequence names its nodes from some depth on, so that is a sum of words from there on.

    Sums are made map-side, so the root and common beginnings don't gather rows; no step depends on how deep the trie is. Null turns come
    first, ties in turn follow a digest of role and text; null role or text is empty; rows with a null conv_id go; repeated rows are
    turns of their own; an empty table gives no node; very long texts are hashed whole. Other columns are ignored.
    """

    def build() -> DataFrame:
        own, convs = rebuilt(conversations)
        members = convs.withColumnRenamed("n", "depth")
        sequences = stored(members.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")))
        firsts = stored(members.select("conv_id", "heads").join(sequences.select("conv_id"), "conv_id", "left_semi"))
        prefixes = stored(_prefixes(own, firsts))
        named = stored(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("up_1").alias("up_1"), F.max("up_2").alias("up_2"), F.max("before").alias("before")))
        names = named.groupBy("conv_id").agg(F.min("depth").alias("names_from"), F.min_by("before", "depth").alias("words_unnamed"))
        parents = named.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_1").alias("key_1"), F.col("up_2").alias("key_2")).agg(F.count("*").alias("n_children"))
        parents = stored(parents)
        # A sequence with a child is a proper prefix of another.
        leaves = sequences.join(parents, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
        words = prefixes.groupBy("conv_id").agg(F.sum("words").alias("all_words"))
        told = stored(sequences.select("conv_id", "weight").join(words, "conv_id").join(names, "conv_id", "left").join(leaves, "conv_id", "left"))
        rows = prefixes.select("conv_id", *NODE, "before").join(told, "conv_id")
        from_here = F.col("weight") * (F.col("all_words") - F.col("before"))
        once = F.when(F.col("names_from").isNull(), 0).otherwise(F.col("all_words") - F.greatest("before", "words_unnamed"))
        nodes = rows.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(from_here - once).cast("long").alias("saved_tokens"))
        above = named.select((F.col("depth") + 1).alias("depth"), F.col("key_1").alias("up_1"), F.col("key_2").alias("up_2"), F.col("conv_id").alias("parent_conv_id"))
        linked = named.drop("before").join(above, ["depth", "up_1", "up_2"], "left")
        out = linked.join(nodes, NODE).join(parents, NODE, "left").join(stored(end_lists(members)), NODE, "left")
        return out.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )

    return settled(build)
