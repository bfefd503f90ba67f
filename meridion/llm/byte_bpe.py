"""Byte-level BPE: a segment tree over byte positions finds each next merge.

Each pre-token has a segment tree whose leaves hold the rank of the pair that starts at a byte
position (NONE where no live pair starts) and whose inner nodes hold the leftmost minimum of their
two children. A merge takes the root, kills the right part and updates the leaves of the live
neighbours, each in a logarithmic number of nodes. The trees of many pre-tokens of like size are the
rows of one matrix, so that one numpy step advances all of them. A long pre-token has a tree of its own,
in which one step makes all merges of the least rank, from the left, up to one that brings a lesser rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces
from .worker import cache

NONE = np.int64(1 << 30)  # above every rank
PLACE = 32  # bits of a position in a tree node; the rank is above them
CACHE_PIECES = 1 << 18  # once full it stays as it is; other pieces are encoded batch by batch
CACHE_BYTES = 64  # longer pieces are encoded each time
MATRIX_CELLS = 1 << 19
LONG_PIECE = 2048  # bytes from which a pre-token has a tree of its own
_codecs: dict = cache()


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks; the rank is the id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.pieces = {v: k for k, v in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.text = {v: str(v) for v in self.pieces}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), NONE)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_group(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most ``size`` bytes, ``size`` a power of two of 2 or more."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        ids = self.byte_id[raw]
        column = np.arange(size)
        ids[column >= length[:, None]] = -1
        after = np.broadcast_to(column + 1, (n, size)).copy()
        before = np.broadcast_to(column - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE << PLACE, np.int64)  # a node holds rank << PLACE | position
        pair = self.pair_rank(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
        pair[column[1:] >= length[:, None]] = NONE
        tree[:, size : 2 * size - 1] = pair << PLACE | column[:-1]
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        tree, ids, after, before = (x.reshape(-1) for x in (tree, ids, after, before))
        levels = size.bit_length() - 1

        def update(node: np.ndarray, value: np.ndarray) -> None:
            """Set leaves; ``node`` counts through all trees, whose roots are at 1, 2 * size + 1, ..."""
            tree[node] = value
            base = node & -(2 * size)
            node = node - base
            for _ in range(levels):
                node = node >> 1
                left = base + 2 * node
                tree[base + node] = np.minimum(tree[left], tree[left + 1])

        row = np.arange(n)
        while True:
            best = tree[row * (2 * size) + 1]
            going = best >> PLACE < NONE
            row, best = row[going], best[going]
            if not len(row):
                break
            rank, at = best >> PLACE, best & ((1 << PLACE) - 1)
            cell, leaf = row * size, row * (2 * size) + size
            gone = after[cell + at]
            follow = after[cell + gone]
            ids[cell + at] = rank
            ids[cell + gone] = -1
            after[cell + at] = follow
            has_next = follow < length[row]
            nxt = (cell + follow)[has_next]
            before[nxt] = at[has_next]
            new = np.full(len(row), NONE)
            new[has_next] = self.pair_rank(rank[has_next], ids[nxt])
            prior = before[cell + at]
            has_prior = prior >= 0
            back = prior[has_prior]
            update(leaf + gone, np.full(len(row), NONE << PLACE))
            update(leaf + at, new << PLACE | at)
            if len(back):
                update(leaf[has_prior] + back, self.pair_rank(ids[cell[has_prior] + back], rank[has_prior]) << PLACE | back)
        ids = ids.reshape(n, size)
        flat = ids[ids >= 0].tolist()
        cut = np.concatenate([[0], np.cumsum((ids >= 0).sum(axis=1))]).tolist()
        return [tuple(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece of two bytes or more."""
        n = len(data)
        size = 1 << (n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(data, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        tree = np.full(2 * size, NONE, np.int64)  # leaves hold ranks; the leftmost least one is found from the root
        tree[size : size + n - 1] = self.pair_rank(ids[:-1], ids[1:])
        level = size
        while level > 1:
            level //= 2
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        while (rank := int(tree[1])) < NONE:
            node = np.ones(1, np.int64)
            while node[0] < size:
                node = (2 * node[:, None] + np.arange(2)).ravel()
                node = node[tree[node] == rank]
            at = node - size
            # Of pairs that share a token the left one comes first, so every other one of a run of them.
            new_run = np.append(True, after[at[:-1]] != at[1:])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
            gone = after[at]
            follow, prior = after[gone], before[at]
            merged_before = np.append(False, prior[1:] == at[:-1])
            has_next, has_prior = follow < n, prior >= 0
            right, left = np.full(len(at), NONE), np.full(len(at), NONE)
            right[has_next] = self.pair_rank(rank, ids[follow[has_next]])
            left[has_prior] = self.pair_rank(np.where(merged_before, rank, ids[prior])[has_prior], rank)
            lesser = np.flatnonzero((right < rank) | (left < rank))
            if len(lesser):  # what it brings is merged before what is further right
                k = int(lesser[0]) + 1
                at, gone, follow, prior, has_next, has_prior, left = (x[:k] for x in (at, gone, follow, prior, has_next, has_prior, left))
            ids[at], ids[gone], after[at] = rank, -1, follow
            before[follow[has_next]] = at[has_next]
            right = np.full(len(at), NONE)
            right[has_next] = self.pair_rank(rank, ids[follow[has_next]])
            tree[size + prior[has_prior]] = left[has_prior]
            tree[size + at], tree[size + gone] = right, NONE
            node = np.unique(np.concatenate([prior[has_prior], at, gone])) + size
            while node[0] > 1:
                node = node >> 1
                node = node[np.append(True, node[1:] != node[:-1])]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return tuple(ids[ids >= 0].tolist())

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        out, groups = {}, {}
        for piece in pieces:
            data = piece.encode()
            whole = self.rank.get(data)
            if whole is not None:
                out[piece] = (whole,)
            elif len(data) >= LONG_PIECE:
                out[piece] = self.merge_long(data)
            else:
                groups.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, members in groups.items():
            step = max(1, MATRIX_CELLS // size)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                out.update(zip((p for p, _ in some), self.merge_group([d for _, d in some], size), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. New pieces of the whole batch are merged together."""
        found = [self.find(t) for t in texts]
        cache, new = self.cache, set()
        for pieces in found:
            new.update(pieces)
        new = [p for p in new if p not in cache]
        fresh = self.encode_pieces(new)
        room = CACHE_PIECES - len(cache)
        keep = [p for p in new if len(p) <= CACHE_BYTES][: max(0, room)]
        cache.update((p, fresh.pop(p)) for p in keep)
        for pieces in found:
            ids: list[int] = []
            for piece in pieces:
                ids += cache[piece] if piece in cache else fresh[piece]
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def _slices(texts: list[str], budget: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= budget:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves if asked for.

    Null counts as the empty text: no ids, hashes of no bytes. Rows stay one to one, repeated doc_ids
    too; an empty table gives no rows; other columns are ignored. Texts and pre-tokens may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        name = bpe.text.__getitem__
        for batch in pieces(batches):
            keys, texts, at = batch.column(0), batch.column(1), 0
            for part in _slices(texts.fill_null("").to_pylist()):
                rows, kept = [], []
                for ids in bpe.encode_batch(part):
                    rows.append((len(ids), hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                    if with_ids:
                        kept.append(ids)
                n, a, b = zip(*rows, strict=True)
                columns = [keys.slice(at, len(part)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                at += len(part)
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null, bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in pieces(batches):
            texts = [None if ids is None else bpe.decode(ids).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
