"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

White space always separates pre-tokens of the word tokenizer, so a text's count is the sum of its
words' counts. Tier one is a compact open-addressing table of the lengths of frequent words, broadcast
(at most ``table_words`` entries of 10 bytes, fixed). Tier two encodes misses with the library and keeps
their lengths in a bounded cache of the worker. Both tiers only hold what the library gave, so what they
hold never changes a count. The table's words are chosen from all documents: every task counts all words
it reads and reports its TASK_WORDS most frequent ones; their sums choose the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, durable_at
from .words import Chunk, chunks

TABLE_WORDS = 1 << 16
TASK_WORDS = 1 << 16  # that a task reports
HELD_WORDS = 1 << 18  # that a task counts at a time; of more, the rarest are forgotten
CACHE_WORDS = 1 << 19
LIMIT = 2048
_LONGEST = 64  # bytes of a word kept in a table or cache
_tokenizers: dict = {}
_cache: dict[bytes, int] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _cache.clear()
    return _tokenizers[path]


def encode_lengths(path: str, words: list[bytes]) -> list[int]:
    found = tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [len(x.ids) for x in found]


class Frequent:
    """Counts of the frequent words of what it is given, by hash; words of over _LONGEST bytes are left out."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, chunk: Chunk) -> None:
        short = np.flatnonzero(chunk.ends - chunk.starts <= _LONGEST)
        keys, first, counts = np.unique(chunk.hashes()[short], return_index=True, return_counts=True)
        raw, own = chunk.data.tobytes(), short[first]
        words = np.empty(len(own), object)
        words[:] = [raw[a:b] for a, b in zip(chunk.starts[own].tolist(), chunk.ends[own].tolist(), strict=True)]
        self.parts.append((keys, counts, words))
        self.n += len(keys)
        if self.n > 2 * HELD_WORDS:
            self.merge(HELD_WORDS)

    def merge(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The counts and words of the ``most`` frequent ones, which are held on."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, object)
        keys, counts, words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else order
        counts = np.add.reduceat(counts[order], start) if len(start) else counts
        keys, words = keys[order[start]], words[order[start]]
        if len(keys) > most:
            kept = np.argpartition(counts, len(counts) - most)[-most:]
            keys, counts, words = keys[kept], counts[kept], words[kept]
        self.parts, self.n = [(keys, counts, words)], len(keys)
        return counts, words


def frequent_words(docs: DataFrame, table_words: int = TABLE_WORDS) -> list[bytes]:
    """The words that tasks report most often in all documents, at most ``table_words``; equally frequent ones are all in or all out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Frequent()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                own.add(chunk)
        counts, words = own.merge(TASK_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.binary()), pa.array(counts)], ["word", "n"])

    counted, path = durable_at(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # At most 512 bins, eight for each doubling of a count, say from which count on there are not too many words.
    bins = {r.b: (r.words, r.least) for r in counted.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    least, held = None, 0
    for b in sorted(bins, reverse=True):
        held += bins[b][0]
        if held > table_words:
            break
        least = bins[b][1]
    found = [] if least is None else [bytes(r.word) for r in counted.where(F.col("n") >= least).collect()]
    discard(docs.sparkSession, path)
    return found


def word_lengths(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of words."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    line = b" ".join(words)
    (chunk,) = chunks(pa.array([line.decode()], pa.large_string()), len(line) + 1)
    return chunk.hashes(), np.array(encode_lengths(path, words), np.uint16)


class LengthTable:
    """Open addressing with linear probing; a free slot has length 0 and key 0."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        keys, at = np.unique(keys, return_index=True)
        keys, lengths = keys[lengths[at] > 0], lengths[at][lengths[at] > 0]
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.lengths = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint16)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.lengths[slot[left]] == 0
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.lengths[slot[put]] = keys[put], lengths[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The length of each key, 0 for a miss."""
        slot, out = self._slot(keys), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            at = slot[left]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.lengths[at[hit]]
            left = left[~hit & (self.lengths[at] != 0)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out


def _missed(path: str, words: list[bytes]) -> list[int]:
    """Lengths of words that the table does not hold; those of at most _LONGEST bytes are remembered."""
    new = list({w for w in words if w not in _cache})
    found = dict(zip(new, encode_lengths(path, new), strict=True)) if new else {}
    if len(_cache) + len(new) > CACHE_WORDS:
        found |= {w: _cache[w] for w in set(words) if w in _cache}
        _cache.clear()
    _cache.update((w, n) for w, n in found.items() if len(w) <= _LONGEST)
    return [found[w] if w in found else _cache[w] for w in words]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``.

    Null and empty texts have 0 bytes and tokens; repeated rows are counted once each, empty tables
    give no rows and other columns are ignored; texts and words may be of any length. ``path`` is the tokenizer's file on every executor.
    """
    table = LengthTable(*word_lengths(path, frequent_words(docs, table_words)))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tokenizer(path)
        for batch in batches:
            sizes = []
            for chunk in chunks(batch.column(1)):
                length = known.find(chunk.hashes())
                miss = np.flatnonzero(length == 0)
                raw = chunk.data.tobytes()
                words = [raw[a:b] for a, b in zip(chunk.starts[miss].tolist(), chunk.ends[miss].tolist(), strict=True)]
                length[miss] = _missed(path, words)
                total = np.concatenate([[0], np.cumsum(length)])
                sizes.append((np.diff(chunk.rows), np.diff(total[chunk.words])))
            n_bytes, n_tokens = (np.concatenate([s[k] for s in sizes]) if sizes else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
