"""Byte-level BPE by replaying merges over the vocabulary of a slab of documents."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped

SLAB_TEXT = 4 << 20
"""Bytes of text whose distinct pieces are merged together."""
KEPT_CHUNKS, KEPT_LENGTH = 40_000, 9
"""A worker keeps encodings of short chunks, the commonest, from slab to slab until it has this many."""
REPLAY_BYTES = 1 << 20
"""Bytes of distinct pieces in one replay."""
NEVER = np.int32(2**31 - 1)


def token_list(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens by id; ids without a token are empty."""
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def bytes_of(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes that little-endian uint32 ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """Ranks of a byte-level BPE, every pair of tokens that joins to a token, and the split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = token_list(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # A token that can go on to a pair of lower rank than its own: its merges must be made one in a word at a time.
        a, b = self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF
        self.steps_back = np.zeros(len(self.tokens), bool)
        self.steps_back[a[self.pair_ranks < a]] = True
        self.steps_back[b[self.pair_ranks < b]] = True

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(parse_ranks(f.read()), pattern)

    def bytes_of(self, ids: bytes) -> bytes:
        return bytes_of(self.tokens, ids)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)


def replay(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Token ids (little-endian uint32) of each non-empty piece.

    All pieces lie end to end in one array. An inverted index holds, for each pair rank, the positions where that
    pair stands; the lowest rank is taken from a heap, applied at all its positions at once, and only the pairs to
    the left and right of them are looked up anew. In a word, this makes the same merges in the same order
    as taking the lowest-ranked pair again and again.
    """
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    token = v.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.arange(1, n + 1, dtype=np.int32)
    after[ends - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[ends - lengths] = -1
    rank = np.full(n, NEVER, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = v.pair_rank(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray, ranks: np.ndarray) -> None:
        some = ranks != NEVER
        at, ranks = at[some], ranks[some]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            r = int(ranks[x])
            if r in index:
                index[r].append(at[x:y])
            else:
                index[r] = [at[x:y]]
                heappush(heap, r)

    add(inner.astype(np.int32), rank[inner])
    heapify(heap)
    while heap:
        r = heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            at = np.unique(at)
            overlap = after[at[:-1]] == at[1:]
            if overlap.any():  # in a run of one token every second pair goes
                first = np.concatenate(([True], ~overlap))
                nth = np.arange(len(at))
                nth -= np.maximum.accumulate(np.where(first, nth, 0))
                at = at[nth % 2 == 0]
            if v.steps_back[r]:
                _, one = np.unique(np.searchsorted(ends, at, side="right"), return_index=True)
                later = np.delete(at, one)
                at = at[one]
                if len(later):
                    index[r] = [later]
                    heappush(heap, r)
        gone = after[at]
        right = after[gone]
        token[at] = r
        token[gone] = -1
        rank[gone] = NEVER
        after[at] = right
        joined = right >= 0
        before[right[joined]] = at[joined]
        rank[at] = NEVER
        a, b = at[joined], right[joined]
        left = before[at]
        c = left[left >= 0]
        both = np.concatenate((a, c))
        new = v.pair_rank(token[both], token[np.concatenate((b, at[left >= 0]))])
        rank[both] = new
        add(both, new)
    alive = np.flatnonzero(token >= 0)
    cuts = np.concatenate(([0], np.searchsorted(alive, ends))) * 4
    blob = token[alive].astype("<u4").tobytes()
    cuts = cuts.tolist()
    return [blob[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def encode_pieces(v: Vocabulary, pieces: Iterable[str]) -> dict[str, bytes]:
    """ids of each distinct piece; a piece that is a token itself is that token."""
    out, rest, size = {}, [], 0

    def flush() -> None:
        if rest:
            out.update(zip(rest, replay(v, [p.encode() for p in rest]), strict=True))
            rest.clear()

    for p in pieces:
        raw = p.encode()
        if raw in v.ranks:
            out[p] = v.ranks[raw].to_bytes(4, "little")
        else:
            rest.append(p)
            size += len(raw)
            if size > REPLAY_BYTES:
                flush()
                size = 0
    flush()
    return out


class Encoder:
    """Encodes slabs of texts.

    A text is cut before each single space between two other characters; no piece of the pattern crosses such a
    cut, so the chunks between them are split and encoded once for all texts of a slab. Texts with other
    white space next to a space are split as a whole.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        find, known = self.v.find, self.kept.copy()
        new: set[str] = set()
        odd: set[str] = set()
        whole: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            chunks = set(rest)
            for c in chunks.difference(new).difference(known):
                if c in odd:
                    continue
                if not c or c[0].isspace() or c[-1].isspace():
                    odd.add(c)
                else:
                    new.add(c)
            if not text or text[0].isspace() or text[-1].isspace() or (odd and not odd.isdisjoint(chunks)) or (rest and first[-1:].isspace()):
                whole[i] = find(text)
            elif " " + first not in known:  # no other chunk has a space
                new.add(" " + first)
        single: list[str] = []  # most chunks: Latin letters, which with the space before them are one piece
        split: dict[str, list[str]] = {}
        for c in new:
            if c.isalpha() and (c.isascii() or max(c) < "\u0250"):
                single.append(c)
            else:
                split[c] = find(c[1:] if c[0] == " " else " " + c)
        del new
        pieces = {p for ps in split.values() for p in ps}
        pieces.update(*whole.values())
        pieces.update([" " + c for c in single])
        ids = encode_pieces(self.v, pieces)
        del pieces
        known.update(zip(single, [ids[" " + c] for c in single], strict=True))
        for c, ps in split.items():
            known[c] = ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps))
        if len(self.kept) < KEPT_CHUNKS:
            self.kept.update((c, known[c]) for c in single if len(c) <= KEPT_LENGTH)
        out = []
        for i, text in enumerate(texts):
            if i in whole:
                out.append(b"".join(map(ids.__getitem__, whole[i])))
            else:
                first, *rest = text.split(" ")
                out.append(known[" " + first] + b"".join(map(known.__getitem__, rest)))
        return out


_loaded: dict[tuple, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary file's content: one in a worker process."""
    at = (hash(data), len(data), pattern)
    if at not in _loaded:
        _loaded.clear()
        _loaded[at] = Encoder(Vocabulary(parse_ranks(data), pattern))
    return _loaded[at]


@lru_cache(maxsize=1)
def _tokens(data: bytes) -> list[bytes]:
    return token_list(parse_ranks(data))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _shared_ranks(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: its size is fixed (about 1 MB), whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", slab_text: int = SLAB_TEXT) -> DataFrame:
    """docs with out_col: the text's token ids as little-endian unsigned 32-bit integers.

    Each task merges the vocabulary of a slab (slab_text bytes) of its documents together; no data move between
    tasks. A smaller slab takes less memory and more time. A null or empty text has no ids. Very long texts form a slab of their own.
    Repeated rows get equal ids, an empty table gives none. Other columns pass through; one that is named out_col is replaced.
    """
    shared = _shared_ranks(docs, path)
    return mapped(docs, text_col, f"`{out_col}` binary", lambda slab: [pa.array(_encoder(shared.value, pattern).encode([t or "" for t in slab.column(text_col).to_pylist()]), pa.binary())], limit=slab_text)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encode and decode in one pass: docs with ids_col and, decoded from it, out_col in place of the text; see encode."""
    shared = _shared_ranks(docs, path)

    def compute(slab: pa.RecordBatch) -> list[pa.Array]:
        encoder = _encoder(shared.value, pattern)
        ids = encoder.encode([t or "" for t in slab.column(text_col).to_pylist()])
        return [pa.array(ids, pa.binary()), pa.array(map(encoder.v.bytes_of, ids), pa.binary())]

    return mapped(docs, text_col, f"`{ids_col}` binary, `{out_col}` binary", compute, drop=(text_col,), limit=SLAB_TEXT)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with out_col: the bytes that ids stand for; null ids give null."""
    shared = _shared_ranks(tokens, path)

    def compute(slab: pa.RecordBatch) -> list[pa.Array]:
        held = _tokens(shared.value)
        return [pa.array([None if x is None else bytes_of(held, x) for x in slab.column(ids_col).to_pylist()], pa.binary())]

    return mapped(tokens, ids_col, f"`{out_col}` binary", compute, limit=4 << 20)
