"""Clusters, prefix trie and packing against brute force, and on odd rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import clustering, packing, prefix_trie, queries

WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")

# 11


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    near = [(i, *nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in near:
        inertia[j] += d
    clip = clustering.LONG
    return sorted((i, j, min(clip, d), min(clip, inertia[j]), min(clip, sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in near)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e20, 1e200])
def test_clusters_are_exact(spark, scale):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 4)) * scale
    rows = [(i, (centres[i % 5] + r.normal(size=4) * 0.2 * scale).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [math.nan] * 4), (903, [math.inf] * 4), (904, [1.0] * 3), (905, [0.0] * 4), (906, [0.0] * 4)]
    found = clustering.clusters(vector_table(spark, rows).repartition(3), k=8, dim=4)
    assert sorted(tuple(x)[:6] for x in found.collect()) == brute_clusters(rows, 8, 3, 4)


def test_clusters_of_few_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert sorted(tuple(x)[:6] for x in clustering.clusters(vector_table(spark, rows), dim=2).collect()) == brute_clusters(rows, 16, 3, 2)
    empty = clustering.clusters(vector_table(spark, rows).limit(0), dim=2)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


@pytest.mark.parametrize("history", [2, 64])
def test_bounds_save_evaluations(history, spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 16)) * 20
    rows = [(i, (centres[r.integers(8)] + r.normal(size=16)).tolist()) for i in range(2000)]
    found = clustering.clusters(vector_table(spark, rows), k=8, dim=16, rounds=6, history=history)
    assert sorted(tuple(x)[:6] for x in found.collect()) == brute_clusters(rows, 8, 6, 16)
    if history == 64:
        assert found.agg(F.sum("evaluated")).first()[0] < 0.2 * 8 * 2000


def test_displacement_is_of_the_whole_way():
    way = [np.array([[0, 0]], object), np.array([[30, 40]], object), np.array([[3, 4]], object)]
    assert clustering.displacements(way).ravel().tolist() == [5.0, 45.0, 0.0]  # summed by rounds, the first would be 95


def test_failing_bounds_are_rescanned():
    r = np.random.default_rng(8)
    x = np.floor(r.normal(size=(400, 6)) * 50)
    history = [np.floor(r.normal(size=(5, 6)) * 50).astype(object)]
    own, far, at = np.zeros(400, np.int64), np.zeros((400, 5), np.float32), np.full((400, 5), -1, np.int16)
    history[0] = np.array([[int(v) for v in c] for c in history[0].tolist()], object)
    for step in range(6):
        own, evaluated = clustering.Assigner(history, 0).assign(x, own, far, at)
        d = ((x[:, None, :] - history[-1].astype(float)[None]) ** 2).sum(axis=2)
        assert own.tolist() == d.argmin(axis=1).tolist()
        assert evaluated == 2000 if step == 0 else evaluated < 2000
        shift = [[int(v) for v in row] for row in np.floor(r.normal(size=(5, 6)) * 4).tolist()]
        history.append(history[-1] + np.array(shift, object))


# 12


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out = []
    for n, ms in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c, end in ms if end)))
        out.append((
            min(ms)[0], len(n), min(members[n[:-1]])[0] if n else None, len(ms), len(kids[n]), sum(not kids[m] for m in below),
            sum((len(members[m]) - 1) * words[m] for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth string"


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-25, 60, 3), 0, 20, 40, 100, 121]:
        texts = [r.choice(["a b c", "a", "", "x y"]) for _ in range(r.randrange(1, 7))]
        rows += [(c, t, r.choice(["user", None, ""]), text or None, "mine") for t, text in enumerate(texts)]
    rows += [(41, t, "user", "w " * (t % 5), "mine") for t in range(300)]  # a long one
    rows += [(c, t, "user", "same words here", "mine") for c in range(200, 320) for t in range(3)]  # a large group
    rows += [(130, None, "u", "first", "m"), (130, 2, "u", "tie b", "m"), (130, 2, "u", "tie a", "m"), (130, 2, "u", "tie a", "m"), (None, 1, "u", "x", "m")]
    return rows


@pytest.mark.parametrize("parts", ["1", "7"])
def test_trie(spark, parts):
    rows = conversations(2)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, found), key=str) == brute_trie([x[:4] for x in rows])


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(5, 1, "u", "a " * 100_000, "x")], TURNS)).collect()
    assert sorted(map(tuple, one), key=str) == brute_trie([(5, 1, "u", "a " * 100_000)])


# 13

ODD = [None, "", " \t\n", "one", "Don't stop: 3 of 44 left!", "É é ÀÇ ﬁ ǅ ß", "é äo", "Σίσυφος ΟΔΟΣ", "😀🙂 x", "a\x1cb c d e\x85f g\xadh", "<|endoftext|> <|startoftext|>x", "x" * 9000, "日本語 と 中文", "'s 's's we'll", "ab\x00cd \x07", "한국어 ｶﾞ İI"]


def whole_tokenizer():
    t = Tokenizer.from_file(WORDS_FILE)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library():
    import pyarrow as pa

    r = random.Random(1)
    letters = "aeé'sß.,1 \n\tÅx-"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(300)]
    encoder, t = packing.WordEncoder(open(WORDS_FILE, encoding="utf-8").read()), whole_tokenizer()
    for part in (texts, texts[::-1], texts[:1]):  # the second time from what it keeps
        ids, ends = encoder.encode(pa.array(part, pa.string()))
        starts = [0, *ends.tolist()]
        assert [ids[a:b].tolist() for a, b in zip(starts, ends.tolist(), strict=False)] == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in part]


def check_packing(rows, texts, capacity):
    t = whole_tokenizer()
    by_doc = defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
    pieces = defaultdict(list)
    for doc_id, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), capacity):
            cut = ids[p : p + capacity]
            pieces[doc_id].append((p // capacity, p, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert {d: sorted((x.piece, x.start, x.length, x.ids_crc32) for x in xs) for d, xs in by_doc.items()} == {d: sorted(x) for d, x in pieces.items()}
    filled = defaultdict(list)
    for x in rows:
        filled[x.sequence_id].append((x.offset, x.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_of_odd_documents(spark):
    texts = [(i, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, length string").repartition(3)
    for capacity in (2048, 16):
        rows = packing.pack_documents(docs, WORDS_FILE, capacity).collect()
        n = check_packing(rows, texts, capacity)
        assert n <= 1.15 * math.ceil(sum(x.length for x in rows) / capacity) + 1
    assert packing.pack_documents(docs.limit(0), WORDS_FILE).count() == 0


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, WORDS_FILE)
    check_packing(rows.collect(), [tuple(x) for x in docs.select("doc_id", "text").collect()], 2048)


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        j = bisect.bisect_left(gaps, x)
        left = capacity if j == len(gaps) else gaps.pop(j)
        n += j == len(gaps) and left == capacity
        if left > x:
            bisect.insort(gaps, left - x)
    return n


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny"])
def test_as_few_sequences_as_best_fit_decreasing(spark, kind):
    r = random.Random(6)
    lengths = {"mixed": [min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(3000)], "equal": [700] * 999, "tiny": [r.randrange(1, 30) for _ in range(4000)]}[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    placed = packing.best_fit(items).join(items, "uid").collect()
    assert len(placed) == len(lengths)
    used = defaultdict(int)
    for x in placed:
        used[x.sequence_id] += x.length
    assert max(used.values()) <= 2048
    assert len(used) <= 1.01 * best_fit_decreasing(lengths, 2048) + 1


def test_sweep_gives_each_piece_its_successor(spark):
    r = random.Random(9)
    rows = [(r.randrange(2), i, 0, r.randrange(1, 12)) for i in range(400)]
    found = packing.swept(spark.createDataFrame(rows, "kind int, id long, slot int, size long")).collect()
    free, want = [], []
    for kind, _, _, size in sorted(rows, key=lambda x: (-x[3], x[0])):
        if kind == 0:
            free.append(size)
        else:
            want.append((size, free.pop() if free else None))
    assert sorted(((x.size, x.mate.size if x.mate else None) for x in found if x.kind == 1), key=str) == sorted(want, key=str)
    pairs = {x.id: x.mate.id for x in found if x.kind == 1 and x.mate}
    assert len(set(pairs.values())) == len(pairs)
    assert {x.mate.id: x.id for x in found if x.kind == 0 and x.mate} == pairs


@pytest.mark.parametrize("name", ["op11_centroids", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    told = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in told.description]
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(tuple, rows.select(*names).collect()), key=str) == sorted(told.fetchall(), key=str)


def test_packing_query(spark):
    rows = queries.QUERIES["op13_packing"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.filter("piece = 0").count() == docs.count() and rows.select("doc_id", "piece").distinct().count() == rows.count()
    told = packing.fill(rows).first()
    assert told.least <= told.sequences <= 1.02 * told.least + 1
