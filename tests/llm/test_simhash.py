import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meridion.llm.graph import components
from meridion.llm.simhash import BUDGET, WIDE_BUDGET, alike_links, described, fingerprint, fingerprints, keep_one, layouts, links, near_duplicates, parity, shingle_set, trie_join, wide_fingerprint, wide_links

from .fixtures import SCHEMA, documents, lowered, prose, words_of


def brute_fingerprint(text):
    words = words_of(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, budget=BUDGET):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    assert [fingerprint(t) for _, t, *_ in documents()] == [brute_fingerprint(t) for _, t, *_ in documents()]


def near_values(seed, bases, flips, most):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, bases, dtype=np.uint64) << np.uint64(1)
    return np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, most), replace=False))) for b in base for _ in range(flips)], np.uint64))


def test_trie_join_of_dense_and_sparse_values(monkeypatch):
    values = near_values(1, 6, 60, 7)
    truth = brute_components(values.tolist())
    for pairs in (3, 50, 1 << 17):
        monkeypatch.setattr("meridion.llm.simhash.PAIRS", pairs)
        label, walk = trie_join(values, np.array([0]))
        assert len({*zip(label.tolist(), truth)}) == len(set(truth)) == len(set(label.tolist()))
        assert walk.links >= len(values) - len(set(truth)) and walk.dropped and walk.deepest > 8


def test_trie_join_below_many_roots():
    parts = [near_values(seed, 2, 12, 6) for seed in range(20)] + [np.zeros(1, np.uint64), np.array([0, ~np.uint64(0)], np.uint64)]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    label, _ = trie_join(np.concatenate(parts), starts)
    for a, part in zip(starts.tolist(), parts):
        truth = brute_components(part.tolist())
        assert len({*zip(label[a : a + len(part)].tolist(), truth)}) == len(set(truth)) == len(set(label[a : a + len(part)].tolist()))


def test_links_connect_all(spark):
    values = near_values(2, 3, 40, 5)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    truth = brute_components(values.tolist())
    for hot in (30, 1 << 16):
        root = {r.node: r.root for r in components(links(df, hot)).collect()}
        got = [root.get(int(v), int(v)) for v in values.view(np.int64)]
        assert len({*zip(got, truth)}) == len(set(truth)) == len(set(got))


def test_default_settings_walk_the_trie(spark):
    """With the operator's own settings every link comes from pairs of nodes that were walked below the layouts' tops."""
    rows = fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).select("fp").distinct()
    near = [int(r.fp) ^ flip for r in rows.limit(40).collect() for flip in (1, 0b1011, 1 << 40 | 1 << 17)]
    laid = layouts(rows.union(spark.createDataFrame([(x,) for x in near], "fp long")).distinct()).orderBy("path", "key", F.col("fp") < 0, "fp").toPandas()
    new = np.append(True, (laid.path.values[1:] != laid.path.values[:-1]) | (laid.key.values[1:] != laid.key.values[:-1]))
    values = laid.fp.values.view(np.uint64)
    label, walk = trie_join(values, np.flatnonzero(new))
    distinct = np.unique(values).tolist()
    truth = brute_components(distinct)
    at = {v: k for k, v in enumerate(distinct)}
    linked = [(at[a], at[b]) for a, b in zip(values[label].tolist(), values.tolist()) if a != b]
    assert linked and all(truth[a] == truth[b] for a, b in linked)
    assert len({k for pair in linked for k in pair}) == sum(n for n in Counter(truth).values() if n > 1)
    assert walk.pairs > walk.links >= len(distinct) - len(set(truth)) and walk.dropped > 0 and walk.deepest >= 16


def test_near_duplicates(spark):
    rows = documents()
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    values = [brute_fingerprint(t) for _, t, *_ in rows]
    parts = brute_components(values)
    least = {}
    for p, (d, *_) in zip(parts, rows):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    assert got == Counter((d, f"{v:016x}", least.get(p)) for (d, *_), v, p in zip(rows, values, parts))
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_wide(text):
    """The wide fingerprint as one number, bit by bit."""
    words = words_of(lowered(text))
    if not words:
        return 0
    out = 0
    mask = (1 << 64) - 1
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    votes = [0] * 512
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(8):
            x = (h + (k + 1) * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            x ^= x >> 31
            for b in range(64):
                votes[64 * k + b] += x >> b & 1
    for b, n in enumerate(votes):
        out |= (2 * n > len(shingles)) << b
    return out


def kept_by_brute_force(rows):
    """Indices of rows that may stay: in each group of near copies those with the least (no doc_id, doc_id), of which one does."""
    values = {t: brute_wide(t) for t in {r[1] for r in rows}}
    parts = brute_components([values[r[1]] for r in rows], WIDE_BUDGET)
    least = {}
    for k, (p, (d, *_)) in enumerate(zip(parts, rows)):
        least.setdefault(p, []).append(((d is None, d or 0), k))
    return [[k for rank, k in own if rank == min(own)[0]] for own in least.values()]


def test_wide_fingerprint():
    for _, t, *_ in documents()[:12] + [(0, None), (0, "one two"), (0, "a b c d e f a b c d e f")]:
        assert int.from_bytes(wide_fingerprint(t), "little") == brute_wide(t)


@pytest.mark.parametrize("hot", [1, 4, 1 << 16])
def test_wide_links_connect_near_copies(spark, hot):
    """Nodes with more fingerprints than allowed ask for further bands; near copies are connected all the same, others are not."""
    rng = np.random.default_rng(3)
    values = []
    for _ in range(5):
        base = rng.integers(0, 256, 64, dtype=np.uint8)
        for _ in range(12):
            bits = np.unpackbits(base)
            bits[rng.choice(512, rng.integers(0, 14), replace=False)] ^= 1
            values.append(np.packbits(bits).tobytes())
    values = sorted(set(values))
    df = spark.createDataFrame(list(enumerate(values)), "id long, fp binary")
    root = {r.node: r.root for r in components(wide_links(df, hot)).collect()}
    truth = brute_components([int.from_bytes(v, "little") for v in values], WIDE_BUDGET)
    got = [root.get(k, k) for k in range(len(values))]
    assert len(set(truth)) == 5 and len({*zip(got, truth)}) == len(set(got)) == 5


def test_close_groups_cost_no_square(spark):
    """Of values that are all linked, pairs are skipped once they are connected; links of equal values go through ``accept``."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    values = np.sort(np.array([base ^ np.uint64(1 << int(k) | 1 << int(j)) for k, j in rng.integers(0, 30, (20_000, 2))], np.uint64))
    began = time.time()
    label, walk = trie_join(values, np.array([0]), 20)
    assert len(set(label.tolist())) == 1 and walk.pairs < 4_000_000 and time.time() - began < 20
    odd = np.arange(len(values)) % 2
    label, _ = trie_join(values[:400], np.array([0]), 20, lambda i, j: odd[i] == odd[j])
    assert {tuple(sorted({int(odd[k]) for k in np.flatnonzero(label == x)})) for x in set(label.tolist())} == {(0,), (1,)}


def test_keep_one(spark):
    rows = documents() + [(7, "an unlike text " + str(k), None, None, None) for k in range(3)] + [(None, f"text {k} of no number", "en", "s", 1) for k in range(2)]
    rows += [(5, rows[3][1], "x", "copy of another row under an id that is used", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "fp.x")
    out = keep_one(df)
    assert out.columns == df.columns
    left = Counter(tuple(r)[:2] for r in out.collect())
    for own in kept_by_brute_force(rows):
        assert sum(left[x] for x in {rows[k][:2] for k in own}) == 1
    assert sum(left.values()) == len(kept_by_brute_force(rows))
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100}


def shingles_of(text):
    w = words_of(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) / len(x | y) if x else 0


def changed(text, seed, words):
    """The text with some of its words replaced."""
    rng = np.random.default_rng(seed)
    own = text.split(" ")
    for k in rng.choice(len(own), words, replace=False):
        own[k] = f"new{seed}word{k}"
    return " ".join(own)


def borderline():
    """Texts with copies on both sides of 0.8, families with many of them, a passage in most texts, lengths of all kinds."""
    common = prose(900, 30)
    texts = []
    for k in range(40):
        base = (common + " " if k % 3 else "") + prose(1000 + k, 60 + 25 * (k % 12), 5000)
        n = len(base.split(" "))
        texts += [base, *(changed(base, 100 * k + c, max(1, round(n * share))) for c, share in enumerate((0.018, 0.022, 0.026)))]
    family = prose(2000, 200, 5000)
    return [*texts, *(changed(family, 9000 + k, 1 + k % 4) for k in range(50)), "one", "two words", "one", "", *(" ".join("abcdefg"[:k]) for k in range(3, 8))]


@pytest.mark.parametrize("hot_token, hot_pairs", [(64, 1 << 12), (4, 8), (1, 0)])
def test_alike_links_are_all_pairs(spark, hot_token, hot_pairs):
    """With every text a group of its own, links are the pairs at 0.8 or more by brute force, whatever is frequent."""
    texts = list(dict.fromkeys(borderline()))
    rows = spark.createDataFrame([((k, ), t) for k, t in enumerate(texts)], "_row struct<k: long>, text string")
    fps = described(rows)
    # The sets' own numbers stand for fingerprints, so that none are merged.
    fps = fps.withColumn("fp", F.col("_row.k").cast("string").cast("binary"))
    groups = spark.createDataFrame([(str(k).encode(), k, k) for k in range(len(texts))], "fp binary, id long, root long")
    got = {tuple(sorted((r.u, r.v))) for r in alike_links(fps, rows, groups, hot_token, hot_pairs).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    assert got == want and len(want) > 150


def test_sketches_differ_in_no_more_bits_than_sets():
    texts = borderline()[:60]
    for a, b in zip(texts, texts[1:]):
        x, y = shingle_set(a), shingle_set(b)
        bits = (np.frombuffer(parity(x), np.uint64) ^ np.frombuffer(parity(y), np.uint64))
        assert int(np.bitwise_count(bits).sum()) <= len(np.setxor1d(x, y))


def test_keep_one_leaves_no_pair_that_is_alike(spark):
    """Fingerprints tell pairs near 0.8 apart by more than WIDE_BUDGET bits, or share no band: they are found all the same."""
    texts = borderline()
    left = [r.text for r in keep_one(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)).collect()]
    assert len(left) == len(set(left)) and not [(a, b) for k, a in enumerate(left) for b in left[:k] if jaccard(a, b) >= 0.8]
