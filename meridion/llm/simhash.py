"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 majority bits of the XXH64 values of 3-word shingles. Equal fingerprints are merged
first. The trie is laid out four times, with another of four 16-bit blocks on top: fingerprints that
differ in at most three bits agree in one block at least, so every link lies below one common node of
some layout, and that node is the partitioning key. Below it the trie, with its one-child chains cut
short, is joined with itself: pairs of nodes are walked together, the differing bits of their common
depth add up, and a pair is dropped once they exceed the budget. The walk takes all nodes of a task at
once, a block of pairs a step, and goes on with the deepest pairs first, so that few are held. A node
with very many fingerprints is laid out again below its block, as its links still have only three bits
to differ in. Links are reduced to a spanning forest before they leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .graph import components
from .tables import discard, durable, durable_at, packed, shuffle_width, unpacked
from .words import mix, pieces
from .worker import lean

SEED = 42
WORDS = 3
BUDGET = 3
HOT_NODE = 1 << 16  # a node of the layouts with more fingerprints is laid out again below its block
PAIRS = 1 << 17  # node pairs that are walked in one step
ROOTS = 1 << 18  # fingerprints whose roots are walked together, at least


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - WORDS + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[k : k + (1 << 16)], np.uint64)
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Components of positions 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j = i[new], j[new]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(a[new], b[new]), np.minimum(a[new], b[new]))
            while True:
                nxt = to[to]
                if (nxt == to).all():
                    break
                to = nxt
            self.label = to[self.label]


@dataclass
class Walk:
    """What a walk met: pairs of different nodes, those of them dropped over budget, the deepest bit at which a pair was split, links."""

    pairs: int = 0
    dropped: int = 0
    deepest: int = 0
    links: int = 0
    kept: list = field(default_factory=list)


def _common(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many leading bits the sorted values first..last-1 share, the depth at which the node splits: 64 for equal ones, 65 for one."""
    x = values[first] ^ values[last - 1]
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.where(last - first == 1, 65, 64 - np.bitwise_count(x).astype(np.int64))


def _halves(values: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the nodes' second children begin: the least value whose bit at the node's depth is set, or the middle of equal ones."""
    shift = np.maximum(63 - depth, 0).astype(np.uint64)
    border = (values[last - 1] >> shift) << shift
    lo, hi = first.copy(), last.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        less = open_ & (values[np.minimum(middle, len(values) - 1)] < border)
        lo, hi = np.where(less, middle + 1, lo), np.where(open_ & ~less, middle, hi)
    return np.where(depth == 64, (first + last) // 2, lo)


class Pairs:
    """Pairs of nodes that wait for the walk, by the depth at which they came up; the deepest are next."""

    def __init__(self):
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, pairs: np.ndarray, depth: np.ndarray) -> None:
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.append(True, depth[order][1:] != depth[order][:-1])) if len(order) else order
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True) if len(order) else ():
            self.waiting.setdefault(int(depth[order[i]]), []).append(pairs[:, order[i:j]])

    def take(self) -> np.ndarray:
        depth = max(self.waiting)
        block = np.concatenate(self.waiting.pop(depth), axis=1)
        if block.shape[1] > PAIRS:
            self.waiting[depth] = [block[:, PAIRS:]]
        return block[:, :PAIRS]


def trie_join(values: np.ndarray, starts: np.ndarray, budget: int = BUDGET, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, Walk]:
    """Component labels of values linked at ``budget`` or fewer differing bits below the same root, and what the walk met.

    ``values`` are 64-bit numbers in order below each root; root k holds those from starts[k] to the next start.
    ``accept`` has the last word on links, given the places of both sides. Deep pairs of nodes are walked
    first, and pairs whose values are connected already are not walked, so that a close group costs about as
    much as a tree over it.
    """
    walk, forest, waiting = Walk(), Forest(len(values)), Pairs()
    ends = np.append(starts[1:], len(values))
    # Each node's two children are a pair; a pair of nodes is two intervals of values.
    a, b = starts[ends - starts > 1], ends[ends - starts > 1]
    while len(a):
        depth = _common(values, a, b)
        m = _halves(values, a, b, depth)
        waiting.add(np.stack([a, m, m, b]), depth)
        a, b = np.concatenate([a, m]), np.concatenate([m, b])
        a, b = a[b - a > 1], b[b - a > 1]
    changes = np.arange(len(values))  # how often the component changes up to a place: equal at both ends of an interval, it is one
    while waiting.waiting:
        a, b, c, d = waiting.take()
        left, right = _common(values, a, b), _common(values, c, d)
        depth = np.minimum(left, right)
        # The bits above the common depth are fixed on both sides; those that differ are spent.
        differing = (values[a] ^ values[c]) & ~np.where(depth >= 64, np.uint64(0), ~np.uint64(0) >> np.minimum(depth, 63).astype(np.uint64))
        going = np.bitwise_count(differing) <= budget
        walk.pairs += len(a)
        walk.dropped += int((~going).sum())
        going &= (changes[a] != changes[b - 1]) | (changes[c] != changes[d - 1]) | (forest.label[a] != forest.label[c])
        link = np.flatnonzero(going & (depth == 65))
        if accept is not None and len(link):
            link = link[accept(a[link], c[link])]
        if len(link):
            walk.links += len(link)
            forest.join(a[link], c[link])
            changes = np.cumsum(np.append(0, forest.label[1:] != forest.label[:-1]))
        going &= depth < 65
        if not going.any():
            continue
        a, b, c, d, left, right, depth = (x[going] for x in (a, b, c, d, left, right, depth))
        walk.deepest = max(walk.deepest, int(depth.max()))
        m, n = b.copy(), d.copy()  # a side that splits deeper is left whole
        x, y = left == depth, right == depth
        m[x] = _halves(values, a[x], b[x], depth[x])
        n[y] = _halves(values, c[y], d[y], depth[y])
        both = x & y
        children = [(a, m, c, n, slice(None)), (a, m, n, d, y), (m, b, c, n, x), (m, b, n, d, both)]
        waiting.add(np.concatenate([np.stack([p[ok], q[ok], r[ok], s[ok]]) for p, q, r, s, ok in children], axis=1), np.concatenate([depth[ok] for *_, ok in children]))
    return forest.label, walk


def _links(keys: list[np.ndarray], fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) below each run of equal keys; all is in the order of keys and fingerprints."""
    if not len(fp):
        return fp, fp
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    label, _ = trie_join(fp, np.flatnonzero(new))
    far = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[far]], fp[far]


def layouts(distinct: DataFrame, hot_node: int = HOT_NODE) -> DataFrame:
    """(fp, path, key): the nodes below which each fingerprint is joined; path numbers a node's blocks, key is the bits in them.

    A path has two bits for each block from the top, after a one. Nodes of more than ``hot_node`` fingerprints
    are laid out again with the bits that are left, until none is hot or no bits are left.
    """

    spark = distinct.sparkSession

    used, found = {1: 0}, []
    rows = distinct.select("fp", F.lit(1).alias("path"), F.lit(0).cast("long").alias("key"))
    while True:
        blocks, deeper = {}, {}
        for path, mask in used.items():
            left = [b for b in range(63, -1, -1) if not mask >> b & 1]
            size = -(-len(left) // (BUDGET + 1))
            blocks[path] = [sum(1 << b for b in left[k * size : (k + 1) * size]) for k in range(BUDGET + 1)]
            deeper |= {4 * path + k: mask | m for k, m in enumerate(blocks[path])}
        if len(blocks) == 1:
            own = [F.struct(F.lit(4 * path + k).cast("int").alias("path"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for k, m in enumerate(blocks[path])]
            laid = rows.select("fp", F.explode(F.array(*own)).alias("x")).select("fp", "x.path", "x.key")
        else:  # four rows for each hot path, few as paths are
            masks = spark.createDataFrame([(p, 4 * p + k, _signed(m)) for p, own in blocks.items() for k, m in enumerate(own)], "path int, child int, mask long")
            laid = rows.join(F.broadcast(masks), "path").select("fp", F.col("child").alias("path"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        sizes = laid.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_node)
        hot = [r.path for r in sizes.select("path").distinct().collect() if deeper[r.path] + 1 < 1 << 64]
        if not hot:
            found.append(laid)
            break
        hot_keys = sizes.where(F.col("path").isin(hot)).select("path", "key", F.lit(True).alias("hot"))
        marked = durable(laid.join(hot_keys, ["path", "key"], "left").select("fp", "path", "key", F.coalesce("hot", F.lit(False)).alias("hot")), "layout")
        found.append(marked.where("not hot").drop("hot"))
        rows, used = marked.where("hot").drop("hot"), {p: deeper[p] for p in hot}
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def links(distinct: DataFrame, hot_node: int = HOT_NODE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within the budget, a spanning forest for each step of a task."""
    # The walk costs more than its few bytes tell, so its partitions are not to be merged by their sizes.
    keyed = layouts(distinct, hot_node).repartition(shuffle_width(distinct.sparkSession), "path", "key").sortWithinPartitions("path", "key", F.col("fp") < 0, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def joined(own: list[np.ndarray]) -> pa.RecordBatch:
            u, v = _links(own[:-1], own[-1].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            own = [batch.column(n).to_numpy() for n in ("path", "key", "fp")]
            rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if len(rest[0]) < ROOTS:
                continue
            # The last root may go on in the next batch.
            other = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield joined([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield joined(rest)

    return keyed.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal doc_ids are judged
    one by one. A component with no doc_id but null has a null component_id. Empty tables give no rows.
    """
    fps = durable(fingerprints(docs), "fingerprints")
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


STAGE_WORDS = 5
WIDE = 8  # 64-bit words of a wide fingerprint
BAND_BYTES = 2
# Shingle sets of similarity J have vectors at an angle of acos(2 J / (1 + J)), of which each bit differs with a
# probability of angle / pi: 15.2 % at 0.8, which is 78 of 512 bits, with a deviation of 8.
WIDE_BUDGET = 85
WORD_BUDGET = 20  # of the 64 bits that a band's trie is made of: 3.6 deviations above the mean of such pairs


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """XXH64 values of a text's different shingles, in order; a text of fewer words is one shingle, none has none."""
    import xxhash

    own = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(own[k : k + words]), SEED) for k in range(max(1, len(own) - words + 1) if own else 0)], np.uint64))


def majority(h: np.ndarray) -> bytes:
    """512 majority bits of eight hashes made of each value; zero of no values."""
    many = mix(h[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(h), 255):  # so that sums fit one byte
        total += np.unpackbits(many[k : k + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes()


def wide_fingerprint(text: str | None, words: int = STAGE_WORDS) -> bytes:
    """The majority bits of a text's shingles, of which equal ones count once."""
    return majority(shingle_set(text, words))


def wide_nodes(distinct: DataFrame, hot_node: int) -> DataFrame:
    """(id, fp, path, key): the nodes below which wide fingerprints are joined, of a table of (id, fp).

    A path is the numbers of the bands that agree, in six bits each, key is what is in them. Fingerprints of a
    node with more than ``hot_node`` of them must agree in another band too, up to three: close ones do in many.
    """
    bands = F.array(*[
        F.struct(F.lit(k + 1).alias("band"), F.conv(F.hex(F.substring("fp", 1 + BAND_BYTES * k, BAND_BYTES)), 16, 10).cast("long").alias("bits")) for k in range(8 * WIDE // BAND_BYTES)
    ])
    rows, found = distinct.select("id", "fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), None
    for level in range(3):
        other = F.filter(bands, lambda x: (x["band"] != F.col("path") % 64) & (x["band"] != F.floor(F.col("path") / 64) % 64))
        laid = rows.select("id", "fp", "path", "key", F.explode(other).alias("x")).select("id", "fp", (F.col("path") * 64 + F.col("x.band")).alias("path"), (F.col("key") * 65536 + F.col("x.bits")).alias("key"))
        sizes = laid.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_node).select("path", "key").hint("shuffle_hash")
        last = level == 2 or not sizes.limit(1).count()
        cold = laid if last else laid.join(sizes, ["path", "key"], "left_anti")
        found = cold if found is None else found.unionByName(cold)
        if last:
            return found
        rows = laid.join(sizes, ["path", "key"], "left_semi")


def wide_links(distinct: DataFrame, hot_node: int = HOT_NODE) -> DataFrame:
    """Links (u, v) of ids whose wide fingerprints differ in at most WIDE_BUDGET bits, a spanning forest for each step of a task.

    ``distinct`` is (id, fp). The bits are cut into bands of 16, and fingerprints that share a band are below
    one node: of pairs at 15 % of differing bits 9 in 10 share one of the 32, of closer ones more. Below it
    the next word's trie is joined with itself, and all bits are counted at its leaves.
    """
    # The walk costs more than its bytes tell, so its partitions are not to be merged by their sizes.
    keyed = wide_nodes(distinct, hot_node).repartition(shuffle_width(distinct.sparkSession), "path", "key").sortWithinPartitions("path", "key")

    def joined(path: np.ndarray, key: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        word = fp[np.arange(len(fp)), ((path % 64 - 1) * BAND_BYTES // 8 + 1) % WIDE]
        order = np.lexsort((word, key, path))
        path, key, ids, fp, word = path[order], key[order], ids[order], fp[order], word[order]
        starts = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
        label, _ = trie_join(word, starts, WORD_BUDGET, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= WIDE_BUDGET)
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[far]]), pa.array(ids[far])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
            own = [*(batch.column(n).to_numpy() for n in ("path", "key", "id")), raw]
            rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if len(rest[0]) < ROOTS // 4:
                continue
            # The last node may go on in the next batch.
            other = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield joined(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield joined(*rest)

    return keyed.mapInArrow(lean(run), "u long, v long").distinct()


HOT_TOKEN = 64  # shingles in more sets' prefixes come last in the order of all
FREQUENT = 1 << 17  # so many of them at most
HOT_PAIRS = 1 << 12  # a shingle with more pairs is dealt again with sketches
PARITY = 16  # 64-bit words of a sketch
SLOTS = 1 << 20


def alike(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with so many in common are alike to 0.8 or more: common >= 0.8 * (n + m - common)."""
    return 9 * common >= 4 * (n + m)


def prefix_size(n: int) -> int:
    """How many first shingles of a set must hold one of any set that is alike, which has 0.8 n of them at least."""
    return n - -(-4 * n // 5) + 1 if n else 0


def parity(h: np.ndarray) -> bytes:
    """Bits that flip with each value: two sets' sketches differ in no more bits than the sets in values."""
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY).astype(np.uint8) & 1).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY)


def _far(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sketches differ in more bits than sets that are alike can in values, (n + m) / 9."""
    return 9 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) > n + m


def _ordered_prefix(h: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set by their hashes, those in ``late`` after all others."""
    is_late = np.isin(h, late)
    return np.concatenate([h[~is_late], h[is_late]])[: prefix_size(len(h))]


def _cross(token: np.ndarray, at: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows below a token (all in the order of token, root) with other roots that can be alike by their sizes and the token's places in them."""
    total = np.arange(len(token))
    own = np.append(np.flatnonzero((token[1:] != token[:-1]) | (root[1:] != root[:-1])) + 1, len(token))
    end = own[np.searchsorted(own, total, "right")]
    count = np.searchsorted(token, token, "right") - end
    rows = np.flatnonzero(count)
    sums = np.cumsum(count[rows])
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + step, "right")))
        k = count[rows[done:upto]]
        i = np.repeat(rows[done:upto], k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(end[rows[done:upto]], k)
        can = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & alike(np.minimum(n[i] - place[i], n[j] - place[j]), n[i], n[j])
        yield i[can], j[can]
        done = upto


def _by_token(names: list[str], work: Callable[[list], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands on whole tokens, of batches in their order, as columns in the order of token and root; the token and the root come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def sent(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((own[1], own[0]))
            return work([x[order] for x in own])

        for batch in batches:
            own = [_sketches(batch.column(n)) if n == "sketch" else batch.column(n).to_numpy().astype(np.int64) for n in names]
            rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            other = np.flatnonzero(rest[0] != rest[0][-1])
            if len(rest[0]) < ROOTS or not len(other):
                continue
            # The last token may go on in the next batch.
            cut = int(other[-1]) + 1
            yield from sent([x[:cut] for x in rest])
            rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from sent(rest)

    return run


def _pairs(at: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair once of about ``most`` at a time, the lesser first; a pair that is found again later comes again."""
    held, total = [], 0

    def once() -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.concatenate(held, axis=1).T, axis=0)
        return pairs[:, 0].copy(), pairs[:, 1].copy()

    for i, j in found:
        held.append(np.sort(np.stack([at[i], at[j]]), axis=0))
        total += len(i)
        if total >= most:
            yield once()
            held, total = [], 0
    if total:
        yield once()


def described(texts: DataFrame) -> DataFrame:
    """Of (_row, text): _row, the wide fingerprint, how many shingles there are, a digest and a sketch of them all, and the first by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            own = [shingle_set(t) for t in batch.column(1).to_pylist()]
            binary = [[f(h) for h in own] for f in (majority, lambda h: xxhash.xxh3_128_digest(h.tobytes(), SEED), parity, lambda h: h[: prefix_size(len(h))].tobytes())]
            fp, shape, sketch, prefix = (pa.array(x, pa.binary()) for x in binary)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, pa.array([len(h) for h in own], pa.int32()), shape, sketch, prefix], ["_row", "fp", "n", "shape", "sketch", "prefix"])

    schema = StructType([texts.schema["_row"], StructField("fp", BinaryType()), StructField("n", IntegerType()), *[StructField(c, BinaryType()) for c in ("shape", "sketch", "prefix")]])
    return texts.mapInArrow(lean(run), schema)


def alike_links(fps: DataFrame, texts: DataFrame, groups: DataFrame, hot_token: int = HOT_TOKEN, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Links (u, v) of the ids of all pairs in different groups whose shingle sets are alike to 0.8 or more, exactly.

    ``fps`` is ``described(texts)``, ``texts`` (_row, text), ``groups`` (fp, id, root). Of two sets that are alike a
    fifth of each, its first shingles in an order of all, has one in common: sets meet below each of these. The
    order is that of hashes, with frequent ones last. Sizes, the places of what is common and sketches rule out
    pairs that can't be alike, and the sets of the others are compared themselves.
    """
    spark = fps.sparkSession
    width = shuffle_width(spark)
    made: list[str] = []

    def held(df: DataFrame, label: str) -> DataFrame:
        df, path = durable_at(df, label)
        made.append(path)
        return df

    first = fps.where("n > 0").groupBy("fp", "shape").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    sets = held(first.join(groups.hint("shuffle_hash"), "fp").select("_row", "n", "sketch", "prefix", "id", "root").withColumn("at", F.monotonically_increasing_id()), "sets")
    schema = "token long, root long, at long, n int, place int"

    def rows_of(own: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        sizes = [len(x) for x, *_ in own]
        columns = [np.concatenate([x for x, *_ in own]).view(np.int64) if own else np.zeros(0, np.int64)]
        columns += [np.repeat(np.array([r[k] for r in own], np.int64), sizes) for k in (1, 2)] + [np.repeat(np.array([r[3] for r in own], np.int32), sizes)]
        columns.append(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]) if own else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "root", "at", "n", "place"])

    def entries(late: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                own = [(np.frombuffer(p, np.uint64), r, a, n) for p, r, a, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "root", "at", "n")), strict=True)]
                yield rows_of([x for x in own if not np.isin(x[0], late).any()] if len(late) else own)

        return run

    slim = sets.select("prefix", "root", "at", "n")
    often = slim.mapInArrow(lean(entries(np.zeros(0, np.uint64))), schema).groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > hot_token)
    late = np.sort(often.orderBy(F.desc("k"), "token").limit(FREQUENT).select("token").toArrow().column(0).combine_chunks().to_numpy().view(np.uint64))
    keyed = slim.mapInArrow(lean(entries(late)), schema)

    def with_texts(rows: DataFrame) -> DataFrame:
        """Rows with the text of their _row; most other texts are left out before they are dealt, by a table of SLOTS at most."""
        slot = (F.xxhash64("_row").bitwiseAND(F.lit(SLOTS - 1))).alias("slot")
        near = texts.withColumn("slot", slot).join(F.broadcast(rows.select(slot).distinct()), "slot", "left_semi").drop("slot")
        return near.join(rows.hint("shuffle_hash"), "_row").dropDuplicates(["at"])

    if len(late):

        def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine = [bool(np.isin(np.frombuffer(p, np.uint64), late).any()) for p in batch.column("prefix").to_pylist()]
                yield batch.filter(pa.array(mine, pa.bool_())).select(["_row", "root", "at"])

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                own = []
                for t, r, a in zip(*(batch.column(c).to_pylist() for c in ("text", "root", "at")), strict=True):
                    h = shingle_set(t)
                    own.append((_ordered_prefix(h, late), r, a, len(h)))
                yield rows_of(own)

        late_rows = held(sets.select("_row", "root", "at", "prefix").mapInArrow(lean(hit), StructType([sets.schema["_row"], sets.schema["root"], sets.schema["at"]])), "late")
        keyed = keyed.unionByName(with_texts(late_rows).select("text", "root", "at").mapInArrow(lean(again), schema))

    def meet(own: list) -> Iterator[pa.RecordBatch]:
        """Pairs (u, v) below tokens with few of them, and (u, place, token) for the others."""
        token, root, at, n, place = own
        cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        parts = np.append(np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (root[1:] != root[:-1]))), len(token))
        size, part = np.diff(cuts), np.diff(parts)
        same = np.add.reduceat(part * part, np.searchsorted(parts, cuts[:-1]))
        crossing = np.repeat((size * size - same) // 2, size)
        few, many = (crossing > 0) & (crossing <= hot_pairs), crossing > hot_pairs
        for u, v in _pairs(at[few], _cross(*(x[few] for x in (token, at, root, n, place)))):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["u", "v", "token"])
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (at, place, token)], ["u", "v", "token"])

    dealt = keyed.repartition(width, "token").sortWithinPartitions("token")
    met = held(dealt.mapInArrow(lean(_by_token(["token", "root", "at", "n", "place"], meet)), "u long, v long, token long"), "met")
    sketches = sets.select("at", "root", "n", "sketch")
    hot = met.where("token is not null").select("token", F.col("u").alias("at"), F.col("v").alias("place")).join(sketches.hint("shuffle_hash"), "at")

    def meet_hot(own: list) -> Iterator[pa.RecordBatch]:
        token, root, at, n, place, sketch = own

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in _cross(token, at, root, n, place, 1 << 15):
                near = ~_far(sketch[i], sketch[j], n[i], n[j])
                yield i[near], j[near]

        for u, v in _pairs(at, close()):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    hot_pairs_ = hot.repartition(width, "token").sortWithinPartitions("token").mapInArrow(lean(_by_token(["token", "root", "at", "n", "place", "sketch"], meet_hot)), "u long, v long")

    def sides(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(of.select(F.col("at").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]).hint("shuffle_hash"), side)
        return pairs

    def not_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 14):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("u_n", "v_n"))
            near = ~_far(_sketches(batch.column("u_sketch")), _sketches(batch.column("v_sketch")), n, m) if len(batch) else np.zeros(0, bool)
            yield batch.filter(pa.array(near, pa.bool_())).select(["u", "v"])

    cold = sides(met.where("token is null").select("u", "v").distinct(), sketches, ["n", "sketch"]).mapInArrow(lean(not_far), "u long, v long")
    pairs = held(cold.union(hot_pairs_).distinct(), "pairs")
    if not pairs.limit(1).count():
        for path in made[:-1]:
            discard(spark, path)
        return pairs
    named = pairs.select(F.col("u").alias("at")).union(pairs.select(F.col("v").alias("at"))).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = pa.array([shingle_set(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("id"), own], ["at", "id", "own"])

    of = sets.select("at", "id", "_row").join(named.hint("shuffle_hash"), "at")
    of = held(with_texts(held(of, "named")).select("at", "id", "text").mapInArrow(lean(whole), "at long, id long, own binary"), "shingles")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("u_own").to_pylist(), batch.column("v_own").to_pylist(), strict=True)]
            ok = [bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))) for a, b in own]
            out = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("u_id"), out.column("v_id")], ["u", "v"])

    out = durable(sides(pairs, of, ["id", "own"]).select("u_id", "v_id", "u_own", "v_own").mapInArrow(lean(compared), "u long, v long"), "alike")
    for path in made:
        discard(spark, path)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the one with the least doc_id (rows without one come last) and of those any one.

    Two rows are near copies if their sets of five-word shingles are alike to 0.8 or more, or if fingerprints that
    meet differ in WIDE_BUDGET of 512 bits at most; groups are what links connect. Fingerprints find most of the
    pairs that are alike, ``alike_links`` all others. Rows without words are copies of each other. Rows are told apart by doc_id
    and two hashes of the text, together 96 bits, so rows that share a doc_id but not their text are judged one
    by one; rows equal in both are copies, of which one stays.
    """
    # "_row" can't clash: the other columns are packed into one.
    own = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    slim = packed(docs)
    named = slim.select(own.alias("_row"), "text")

    fps = durable(described(named), "fingerprints")
    # Numbered as it is written, once.
    distinct = durable(fps.groupBy("fp").agg(F.min("_row").alias("least")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    roots = components(wide_links(distinct.select("id", "fp")))
    groups = distinct.join(roots, distinct.id == roots.node, "left").select("fp", "id", "least", F.coalesce("root", "id").alias("root"))
    more = alike_links(fps, named, groups.drop("least"))
    if more.limit(1).count():
        roots = components(more.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        groups = distinct.join(roots, distinct.id == roots.node, "left").select("fp", "id", "least", F.coalesce("root", "id").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("_row"))
    # What is kept grows with the input; the hints keep it from being broadcast at any size.
    keep = durable(least.select("_row").join(fps.groupBy("_row").agg(F.count("*").alias("n")).hint("shuffle_hash"), "_row"), "kept")

    def chosen(condition: str) -> DataFrame:
        return slim.withColumn("_row", own).join(keep.where(condition).select("_row").hint("shuffle_hash"), "_row", "left_semi")

    out = chosen("n = 1")
    if keep.where("n > 1").limit(1).count():
        out = out.union(chosen("n > 1").dropDuplicates(["_row"]))
    return unpacked(out, docs)
