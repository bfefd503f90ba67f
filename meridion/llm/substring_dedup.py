"""Substring dedup with prefix-partitioned suffix trees over words.

The suffixes of all documents, cut at ``width`` words, are dealt to groups. A suffix's anchor is the least
hashed run of six words in it; its group is that of the shortest prefix of the suffix at the anchor (1, 2, 4
or 6 words) with which not too many go together, by counts of all of them. So neighbouring suffixes of one
anchor travel together, as one short text. Where six words are not enough, the whole suffix decides. A group
is one subtree. It is held as a suffix array: its suffixes in the order of their words, which are compared
themselves, and the number of words that neighbours have in common. An internal node is an interval of it;
one of depth ``width`` says that its words repeat. The least doc_id there keeps them, all its other
documents lose them.

Two things keep the subtrees small. A suffix can only repeat if its anchor does, so anchors are looked up
first and suffixes of others never leave their task. And a task sorts the suffixes of each of its
documents' homes first and sends on those of the least doc_id of each node only, so that what repeats in a
third of all documents is sent once a home.

Documents are spread over homes by row, whatever their doc_ids, of which there are as many as keep a home
at HOME words on average. Words are told apart by 64-bit hashes inside one home, by themselves across homes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffle_width
from .words import U64, Chunk, chunks, mix

WIDTH = 13
ANCHOR = 6
PORTION = 1 << 21  # minimisers that a task gathers before it sends them
HOME = 1 << 20  # words of a home, on average
GROUP = 1 << 21  # suffixes of a group, at most where prefixes can be longer
KEY_BITS = 48  # of a minimiser by which a bucket tells them apart, and by which a home does; clashes only let more
HOME_BITS = 40  # suffixes through, and are few, as neither gets larger with the input
MOST_BINS = 1 << 20  # of the prefixes of one length, so that the plan has at most 16 MB
STEP = U64(0xC2B2AE3D27D4EB4F)


def homes(width: int, n_words: int = 0) -> int:
    """A prime of half as many again as partitions, at least, and of so many that a home has HOME words."""
    n = max(3 * width // 2, n_words // HOME) + 1
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _starts(chunk: Chunk, width: int) -> np.ndarray:
    """Each window's first word."""
    n = max(0, len(chunk.starts) - width + 1)
    left = np.repeat(chunk.words[1:], np.diff(chunk.words))  # the end of each word's row
    return np.flatnonzero(np.arange(n) + width <= left[:n])


def _minimisers(chunk: Chunk, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's first word, its minimiser, and its anchor: the word at which the minimiser's (first) run begins."""
    n, at = max(0, len(words) - width + 1), _starts(chunk, width)
    short = min(ANCHOR, width)
    grams = np.zeros(max(0, len(words) - short + 1), U64)
    for k in range(short):
        grams = grams * STEP + words[k : k + len(grams)]
    grams ^= grams >> U64(29)
    grams *= U64(0x94D049BB133111EB)
    grams ^= grams >> U64(32)
    least, anchor = grams[:n].copy(), np.arange(n)
    for k in range(1, width - short + 1):
        less = np.flatnonzero(grams[k : k + n] < least)
        least[less] = grams[less + k]
        anchor[less] = less + k
    return at, least[at], anchor[at]


def depths(width: int) -> list[int]:
    short = min(ANCHOR, width)
    return [d for d in (1, 2, 4) if d < short] + [short]


def _prefixes(words: np.ndarray, anchor: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each of ``depths`` the hash of so many words from each anchor."""
    out = np.zeros(len(anchor), U64)
    for k in range(depths(width)[-1]):
        out = out * STEP + words[anchor + k]
        if k + 1 in depths(width):
            yield mix(out)


@dataclass
class Plan:
    """The group of each bin of prefix hashes, a row for each depth; -1 where a longer prefix decides.

    Suffixes that no prefix at their anchor decides are dealt by all their words to groups from ``rest`` on.
    """

    groups: np.ndarray
    rest: int
    n_rest: int
    n_words: int

    def group_of(self, words: np.ndarray, at: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
        bits, out = U64(65 - self.groups.shape[1].bit_length()), np.full(len(at), -1, np.int32)
        run, of = _runs(anchor)
        found = np.full(len(run), -1, np.int32)
        for own, key in zip(self.groups, _prefixes(words, anchor[run], width), strict=True):
            found = np.where(found < 0, own[(key >> bits).astype(np.int64)], found)
        out = found[of]
        left = np.flatnonzero(out < 0)
        if len(left):
            key = np.zeros(len(left), U64)
            for k in range(width):
                key = key * STEP + words[at[left] + k]
            out[left] = self.rest + (mix(key) % U64(self.n_rest)).astype(np.int32)
        return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and each one's run."""
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def prefix_plan(docs: DataFrame, width: int, groups: int) -> Plan:
    """Deals bins of prefixes to ``groups`` groups or more, from counts of all suffixes by all lengths of prefixes.

    A bin's count is an upper bound of the suffixes it gets, as shorter prefixes take some. A node of all
    ``width`` words can't be split; what repeats so often is sent once a home.
    """

    def counted(bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(depths(width)), bins), np.int64)
            n_words, shift = 0, U64(65 - bins.bit_length())
            for batch in batches:
                for chunk in chunks(batch.column(0)):
                    words = chunk.hashes()
                    n_words += len(words)
                    _, _, anchor = _minimisers(chunk, words, width)
                    first, _ = _runs(anchor)
                    weight = np.diff(np.append(first, len(anchor)))
                    for own, key in zip(total, _prefixes(words, anchor[first], width), strict=True):
                        own += np.bincount((key >> shift).astype(np.int64), weights=weight, minlength=bins).astype(np.int64)
            depth, some = np.nonzero(total)
            rows = [np.append(depth, -1), np.append(some, 0), np.append(total[depth, some], n_words)]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["depth", "bin", "n"])

        return run

    # Bins grow with the input; its size in bytes says how many are needed without another pass over the words.
    rough = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 6).first()[0]
    bins = min(MOST_BINS, 1 << max(12, int(4 * max(groups, rough / GROUP)).bit_length()))
    rows = docs.select("text").mapInArrow(counted(bins), "depth int, bin int, n long").groupBy("depth", "bin").agg(F.sum("n").alias("n")).toArrow()
    depth, at, n = (rows[c].to_numpy() for c in ("depth", "bin", "n"))
    count, n_words = np.zeros((len(depths(width)), bins), np.int64), int(n[depth < 0].sum())
    count[depth[depth >= 0], at[depth >= 0]] = n[depth >= 0]
    size = max(1, min(GROUP, -(-n_words // groups)), n_words // (MOST_BINS // 4))
    plan, group, room, share = np.full(count.shape, -1, np.int32), 0, float(size), 1.0
    for k, own in enumerate(count):
        cold = own <= size
        for b in np.flatnonzero(cold).tolist():
            if own[b] * share > room and room < size:
                group, room = group + 1, float(size)
            plan[k, b] = group
            room -= own[b] * share
        # The part of all suffixes that needs a longer prefix, for the expected size of what longer prefixes get.
        share = float(own[~cold].sum()) / max(1, n_words)
    return Plan(plan, group + 1, max(1, int(share * n_words) // size + 1), n_words)


# Minimisers --------------------------------------------------------------------------------------------------

SENT = "bucket int, leaves binary, home int, answers binary"
ANSWERS = "home int, answers binary"
LOCAL = 8  # rows of one minimiser that a portion sends on; of more, it settles all itself
SETTLED = -(1 << 62)  # stands for rows that have their answer already


def _indexed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each one's place among them, in two bytes where they fit."""
    table, place = np.unique(values, return_inverse=True)
    return table, place.astype(np.uint16 if len(table) < 1 << 16 else np.uint32)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays or bytes one after another, compressed, with their types and sizes in front."""
    import zstandard

    parts = [np.frombuffer(a, np.uint8) if isinstance(a, bytes) else np.ascontiguousarray(a) for a in arrays]
    head = [len(parts)] + [x for p in parts for x in (ord(p.dtype.str[1]), p.dtype.itemsize, p.size)]
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(p.tobytes() for p in parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 3 * n, 8).reshape(n, 3).tolist()
    out, at = [], 8 + 24 * n
    for kind, size, count in head:
        out.append(np.frombuffer(data, np.dtype(f"{chr(kind)}{size}"), count, at))
        at += size * count
    return out


def _steps_packed(sorted_numbers: np.ndarray) -> bytes:
    """Numbers by their distances, first all low bytes, then all next ones: the high ones are mostly zero and cost nothing."""
    return np.diff(sorted_numbers, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _steps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def _pairs_packed(keys: np.ndarray, rows: np.ndarray) -> bytes:
    """Minimisers, in order, by KEY_BITS of each, and their rows."""
    return _pack(_steps_packed(keys >> U64(64 - KEY_BITS)), *_indexed(rows))


def _pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x) for x in blobs]
    return np.concatenate([_steps(p[0]) for p in parts]), np.concatenate([p[1][p[2]] for p in parts])


def _keys_packed(keys: np.ndarray) -> bytes:
    """The different ones of some minimisers, given by HOME_BITS of each."""
    return _pack(_steps_packed(np.unique(keys)))


def _keys(blobs: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([_steps(_unpack(x)[0]) for x in blobs])) if blobs else np.zeros(0, U64)


def _cells_packed(rows: np.ndarray, at: np.ndarray) -> bytes:
    """Rows and places in them, in order; steps from one place to the next compress best."""
    order = np.lexsort((at, rows))
    table, place = _indexed(rows[order])
    return _pack(table, np.diff(place.astype(np.int64), prepend=0).astype(np.uint32), np.diff(at[order], prepend=0).astype(np.int32))


def _cells(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x) for x in blobs]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([t[np.cumsum(p, dtype=np.int64)] for t, p, _ in parts]), np.concatenate([np.cumsum(a, dtype=np.int64) for _, _, a in parts])


def _dealt(target: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The targets, and for each one what ``packed`` makes of the indices that go there."""
    if not len(target):
        return target, []
    order = np.argsort(target, kind="stable")
    cut = np.flatnonzero(np.append(True, target[order][1:] != target[order][:-1]))
    ends = np.append(cut[1:], len(target))
    return target[order][cut], [packed(order[a:b]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]


def _leaves(bucket: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    to, blobs = _dealt(bucket, packed)
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["bucket", "leaves", "home", "answers"])


def _answers(rows: np.ndarray, n_homes: int, packed: Callable[[np.ndarray], bytes], whole: bool = True) -> pa.RecordBatch:
    to, blobs = _dealt(rows % n_homes, packed)
    n = len(blobs)
    own = [pa.array(to, pa.int32()), pa.array(blobs, pa.binary())]
    if not whole:
        return pa.RecordBatch.from_arrays(own, ["home", "answers"])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *own], ["bucket", "leaves", "home", "answers"])


class Portion:
    """Gathers (key, row) pairs and sends them when there are enough."""

    def __init__(self, send: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], limit: int):
        self.send, self.limit, self.parts, self.n = send, limit, [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.n += len(part[0])
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from self.send(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.n = [], 0


def _settled(sent: DataFrame, partitions: int, judge: Callable[[list[bytes]], pa.RecordBatch]) -> DataFrame:
    """(home, answers): those given before and those that ``judge`` gives for each bucket's leaves, a bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            given = batch.filter(batch.column(0).is_null()).select(["home", "answers"])
            if len(given):
                yield given
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b is None:
                    continue
                if b != bucket and held:
                    yield judge(held)
                    held = []
                bucket = b
                held.append(blob.as_py())
        if held:
            yield judge(held)

    # Leaves meet by bucket, in its order; answers, which have none, are spread by home and come first.
    dealt = sent.repartitionById(partitions, F.pmod(F.coalesce("bucket", "home"), F.lit(partitions)).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, ANSWERS).repartition(partitions, "home")


def _member(numbers: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(numbers), bool)
    at = np.minimum(np.searchsorted(among, numbers), len(among) - 1)
    return among[at] == numbers


def repeated_anchors(dealt: DataFrame, width: int, n_homes: int, portion: int = PORTION) -> DataFrame:
    """(home, answers): the minimisers of each home's rows that another row has too. There are as many buckets as homes.

    ``dealt`` is (doc_id, text, row, home); rows without a doc_id are left out.
    """
    partitions = shuffle_width(dealt.sparkSession)

    def send(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))
        keys, rows = keys[new], rows[new]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(start, len(keys)))
        many = np.repeat(count > LOCAL, count)
        if many.any():
            own_keys, own_rows = keys[many], rows[many]
            yield _answers(own_rows, n_homes, lambda k: _keys_packed(own_keys[k] >> U64(64 - HOME_BITS)))
        # A minimiser that the portion has settled goes on once, for others to learn of it.
        first = np.zeros(len(keys), bool)
        first[start] = True
        sent = ~many | first
        keys, rows = keys[sent], np.where(many, SETTLED, rows)[sent]
        yield _leaves((keys % U64(n_homes)).astype(np.int32), lambda k: _pairs_packed(keys[k], rows[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Portion(send, portion)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            rows = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1)):
                at, least, _ = _minimisers(chunk, chunk.hashes(), width)
                own = rows[chunk.first + np.searchsorted(chunk.words, at, "right") - 1]
                new = np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1]))[: len(least)]
                yield from gathered.add(least[new], own[new])
        yield from gathered.flush()

    def judge(blobs: list[bytes]) -> pa.RecordBatch:
        keys, rows = _pairs(blobs)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.append(True, keys[1:] != keys[:-1])
        start = np.flatnonzero(first)
        several = np.minimum.reduceat(rows, start) != np.maximum.reduceat(rows, start)
        good = several[np.cumsum(first) - 1] & (rows != SETTLED)
        keys, rows = keys[good], rows[good]
        return _answers(rows, n_homes, lambda k: _keys_packed(keys[k] >> U64(KEY_BITS - HOME_BITS)), whole=False)

    # All columns and rows, so that the shuffle is the same one as later steps read.
    return _settled(dealt.mapInArrow(run, SENT), partitions, judge)


# Subtrees ----------------------------------------------------------------------------------------------------


@dataclass
class Subtree:
    """Suffixes in the order of their words: ``order`` of the given ones, ``common`` words with the one before."""

    order: np.ndarray
    common: np.ndarray

    def nodes(self, depth: int) -> np.ndarray:
        """Where the intervals of suffixes that share ``depth`` words begin."""
        return np.flatnonzero(self.common < depth)

    def internal(self) -> dict[int, int]:
        """How many internal nodes there are of each depth: intervals that neighbours within share exactly so many words of."""
        out: dict[int, int] = {}
        open_: list[int] = []
        for x in self.common[1:].tolist():
            while open_ and open_[-1] > x:
                open_.pop()
            if x and (not open_ or open_[-1] < x):
                open_.append(x)
                out[x] = out.get(x, 0) + 1
        return out


def subtree(words: np.ndarray, size: int) -> Subtree:
    """The subtree of suffixes, rows of word ranks below ``size``."""
    n, width = words.shape
    bits = max(1, (size - 1).bit_length())
    each = 64 // bits  # words that fit one number
    columns = []
    for k in range(0, width, each):
        packed = np.zeros(n, U64)
        for j in range(k, min(width, k + each)):
            packed = packed << U64(bits) | words[:, j].astype(U64)
        columns.append(packed)
    order = np.lexsort(columns[::-1])
    common = np.zeros(n, np.int64)
    same = np.ones(max(0, n - 1), bool)
    for k in range(width):
        own = words[order, k]
        same &= own[1:] == own[:-1]
        common[1:] += same
    return Subtree(order, common)


def _least(tree: Subtree, ids: np.ndarray, width: int) -> np.ndarray:
    """For each suffix, in the tree's order, the least document of its node of depth ``width``."""
    start = tree.nodes(width)
    return np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(ids)))) if len(ids) else ids


def _suffixes_packed(words: np.ndarray, strings: list[bytes], start: np.ndarray, size: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int) -> bytes:
    """Stretches of ``size`` suffixes that follow each other, with the words they have, each word's string once."""
    length = size + width - 1
    used, place = _indexed(words[_spread(start, length)])
    small = np.uint8 if size.max() < 256 else np.uint32
    return _pack(b"\n".join([strings[k] for k in used.tolist()]), place, size.astype(small), *_indexed(ids), *_indexed(rows), np.diff(at, prepend=0).astype(np.int32))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _suffixes(blobs: list[bytes], width: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of many blobs as rows of ranks in their common words, how many those are, and documents, rows and places."""
    parts = [_unpack(x) for x in blobs]
    own = [p[0].tobytes().split(b"\n") for p in parts]
    rank = {w: k for k, w in enumerate(sorted(set().union(*own)))}
    words = np.concatenate([np.array([rank[w] for w in strings], np.uint32)[p[1]] for strings, p in zip(own, parts, strict=True)])
    size = np.concatenate([p[2] for p in parts]).astype(np.int64)
    ids, rows = (np.repeat(np.concatenate([p[k][p[k + 1]] for p in parts]), size) for k in (3, 5))
    at = _spread(np.concatenate([np.cumsum(p[7], dtype=np.int64) for p in parts]), size)
    length = size + width - 1
    first = _spread(np.cumsum(length) - length, size)
    return np.stack([words[first + k] for k in range(width)], axis=1), len(rank), ids, rows, at


def first_alike(texts: pa.Table) -> np.ndarray:
    """For each row of a home the place of the row of least number with its doc_id and text: equal rows go through the steps once."""
    if not len(texts):
        return np.zeros(0, np.int64)
    number = lambda name: pc.fill_null(texts[name].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(texts["row"].to_numpy(), kind="stable")
    pair = np.stack([number("doc_id"), number("text")], axis=1)[order]
    _, first, of = np.unique(pair, axis=0, return_index=True, return_inverse=True)
    out = np.empty(len(order), np.int64)
    out[order] = order[first[of.reshape(-1)]]
    return out


class Home:
    """The suffixes of a home's documents that may repeat: where they begin in ``ranked``, the ranks of their words among ``strings``."""

    def __init__(self, texts: pa.Table, among: np.ndarray, width: int, plan: Plan):
        parts, kept = [], []
        known = texts.take(np.unique(first_alike(texts)))
        known = known.filter(known["doc_id"].is_valid())
        ids, rows, first = known["doc_id"].to_numpy(), known["row"].to_numpy(), 0
        for chunk in chunks(known["text"]) if len(among) else ():
            words = chunk.hashes()
            at, least, anchor = _minimisers(chunk, words, width)
            row = np.searchsorted(chunk.words, at, "right") - 1
            good = _member(least >> U64(64 - HOME_BITS), among)
            at, row, anchor = at[good], row[good], anchor[good]
            if not len(at):
                continue
            # Only words of these suffixes are taken along.
            cover = np.cumsum(np.bincount(at, minlength=len(words) + 1) - np.bincount(at + width, minlength=len(words) + 1))[:-1] > 0
            place = np.cumsum(cover) - 1 + first
            own = np.flatnonzero(cover)
            kept.append((words[own], chunk.data.tobytes(), chunk.starts[own], chunk.ends[own]))
            parts.append((place[at], place[anchor], ids[chunk.first + row], rows[chunk.first + row], at - chunk.words[row], plan.group_of(words, at, anchor, width)))
            first += len(own)
        self.width = width
        if not parts:
            self.start, self.ranked, self.strings = np.zeros(0, np.int64), np.zeros(width - 1, np.uint32), []
            return
        self.start, self.anchor, self.ids, self.rows, self.at, self.group = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes = np.concatenate([k[0] for k in kept])
        _, example, place = np.unique(hashes, return_index=True, return_inverse=True)
        cuts = np.cumsum([0] + [len(k[0]) for k in kept])
        of = np.searchsorted(cuts, example, "right") - 1
        strings = [kept[c][1][kept[c][2][e] : kept[c][3][e]] for c, e in zip(of.tolist(), (example - cuts[of]).tolist(), strict=True)]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        self.strings = [strings[k] for k in order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        self.ranked = rank[place]

    def tree(self) -> Subtree:
        suffixes = np.stack([self.ranked[self.start + k] for k in range(self.width)], axis=1)
        return subtree(suffixes, max(1, len(self.strings)))

    def sent(self, n_homes: int) -> Iterator[pa.RecordBatch]:
        """Answers to suffixes of which a document with a lesser id is in the same home, and the others for their groups."""
        if not len(self.start):
            return
        tree = self.tree()
        lost = np.zeros(len(self.start), bool)
        lost[tree.order] = self.ids[tree.order] > _least(tree, self.ids[tree.order], self.width)
        if lost.any():
            own_rows, own_at = self.rows[lost], self.at[lost]
            yield _answers(own_rows, n_homes, lambda k: _cells_packed(own_rows[k], own_at[k]))
        if lost.all():
            return
        on = np.flatnonzero(~lost)
        start, group = self.start[on], self.group[on]
        # Stretches of one row, anchor and group; a home's words don't run on from row to row, as anchors differ there.
        new = np.append(True, (start[1:] != start[:-1] + 1) | (self.anchor[on[1:]] != self.anchor[on[:-1]]) | (group[1:] != group[:-1]))
        first = np.flatnonzero(new)
        size, on = np.diff(np.append(first, len(on))), on[first]
        yield _leaves(
            self.group[on],
            lambda k: _suffixes_packed(self.ranked, self.strings, self.start[on[k]], size[k], self.ids[on[k]], self.rows[on[k]], self.at[on[k]], self.width),
        )


def removable(dealt: DataFrame, plan: Plan, n_homes: int, width: int = WIDTH, portion: int = PORTION) -> DataFrame:
    """(home, answers): rows and places of the windows that also start in a document with a smaller doc_id.

    ``dealt`` is (doc_id, text, row, home), dealt by home; its shuffle is used again.
    """
    spark = dealt.sparkSession
    partitions = shuffle_width(spark)
    shared = spark.sparkContext.broadcast(plan)  # at most four numbers for each of MOST_BINS bins
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.int32(), pa.binary())], ["bucket", "leaves", "home", "answers"])

    def group(texts, answers):
        among = _keys(answers["answers"].to_pylist())
        return pa.Table.from_batches([empty, *Home(texts, among, width, shared.value).sent(n_homes)])

    def judge(blobs: list[bytes]) -> pa.RecordBatch:
        suffixes, size, ids, rows, at = _suffixes(blobs, width)
        tree = subtree(suffixes, size)
        ids = ids[tree.order]
        lost = tree.order[ids > _least(tree, ids, width)]
        rows, at = rows[lost], at[lost]
        return _answers(rows, n_homes, lambda k: _cells_packed(rows[k], at[k]), whole=False)

    anchors = repeated_anchors(dealt, width, n_homes, portion)
    sent = dealt.groupBy("home").cogroup(anchors.groupBy("home")).applyInArrow(group, SENT)
    return _settled(sent, partitions, judge)


def _kept(chunk: Chunk, row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether it stays, and for each row its stretches of removed words; ``row`` and ``place`` of the lost windows."""
    where = np.sort(chunk.words[row] + place)
    of = np.searchsorted(chunk.words, where, "right") - 1
    cover = np.bincount(where, minlength=len(chunk.starts) + 1) - np.bincount(where + width, minlength=len(chunk.starts) + 1)
    new = np.append(True, (where[1:] > where[:-1] + width) | (of[1:] != of[:-1]))[: len(where)]
    return np.cumsum(cover)[:-1] == 0, np.bincount(of[new], minlength=len(chunk))


def deduplicate(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans of each row, and the kept text if asked for.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller doc_id.
    Null texts have no words (the hash of nothing); rows without a doc_id lose nothing and count for no
    other; rows that share a doc_id don't count against each other; texts of fewer words stay. n_spans
    counts stretches of removed windows that touch.
    """
    partitions = shuffle_width(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = prefix_plan(read.where("doc_id is not null"), width, partitions)
    n_homes = homes(partitions, plan.n_words)
    # Rows are numbered once, before the shuffle that all later steps read.
    numbered = read.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("home", F.pmod("row", F.lit(n_homes)).cast("int")).repartition(partitions, "home")

    def group(texts, answers):
        rows = texts["row"].to_numpy()
        lost_rows, lost_at = _cells(answers["answers"].to_pylist())
        order = np.argsort(rows)
        index = order[np.searchsorted(rows, lost_rows, sorter=order)] if len(lost_rows) else lost_rows
        order = np.argsort(index, kind="stable")
        index, lost_at = index[order], lost_at[order]
        # Equal rows have the answers of the first of them.
        alike = first_alike(texts)
        start = np.searchsorted(index, alike)
        size = np.searchsorted(index, alike, "right") - start
        index, lost_at = np.repeat(np.arange(len(alike)), size), lost_at[_spread(start, size)]
        out = []
        for chunk in chunks(texts["text"]):
            a, b = np.searchsorted(index, (chunk.first, chunk.first + len(chunk)))
            keep, spans = _kept(chunk, index[a:b] - chunk.first, lost_at[a:b], width)
            raw = chunk.data.tobytes()
            starts, ends, stays = chunk.starts.tolist(), chunk.ends.tolist(), keep.tolist()
            lost = np.diff(np.concatenate([[0], np.cumsum(~keep)])[chunk.words]).tolist()
            cuts = chunk.words.tolist()
            for k in range(len(chunk)):
                a, b = cuts[k], cuts[k + 1]
                if lost[k]:
                    text = b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if stays[i]])
                else:
                    text = b" ".join(raw[starts[a] : ends[b - 1]].split()) if a < b else b""
                out.append((b - a, lost[k], hashlib.sha256(text).hexdigest(), int(spans[k]), text.decode() if with_text else None))
        columns = zip(*out, strict=True) if out else ([],) * 5
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "kept_text"][: 5 + with_text]
        return pa.table([texts["doc_id"].combine_chunks(), *columns][: len(names)], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text
    answers = removable(dealt, plan, n_homes, width)
    return dealt.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(group, schema)
