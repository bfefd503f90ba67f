import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridion.llm.substring_dedup import Home, _keys, deduplicate, first_alike, prefix_plan, repeated_anchors, subtree

from .fixtures import SCHEMA, documents, prose, words_of


def brute(rows, width):
    first = {}
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = Counter()
    for d, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def result(df, width=13):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in deduplicate(df, width, with_text=True).collect())


@pytest.mark.parametrize("local", [1, 8])
@pytest.mark.parametrize("width", [5, 13])
def test_against_brute_force(spark, monkeypatch, local, width):
    monkeypatch.setattr("meridion.llm.substring_dedup.LOCAL", local)
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "home").withColumnRenamed("source", "keys")
    assert result(df, width) == brute(rows, width)


def test_many_small_homes_and_groups(spark, monkeypatch):
    """Prefixes of all lengths decide, and nodes are closed by homes and by groups."""
    monkeypatch.setattr("meridion.llm.substring_dedup.HOME", 200)
    monkeypatch.setattr("meridion.llm.substring_dedup.GROUP", 40)
    rows = documents() + [(500 + k, prose(40, 60) + f" tail {k}", "en", "s", 1) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    plan = prefix_plan(df.select("text"), 13, 4)
    assert all((own >= 0).any() and (own < 0).any() for own in plan.groups) and plan.rest > 50 and plan.n_rest > 1
    assert result(df) == brute(rows, 13)


def test_missing_and_hot_doc_ids(spark):
    rows = documents() + [(None, prose(k, 40), "en", "s", 1) for k in range(60)] + [(3, prose(k % 5, 40), "en", "s", 1) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute(rows, 13)


def test_equal_rows_go_through_once(spark):
    table = pa.table({"doc_id": [3, None, 3, 3, None, 4], "text": ["a", "a", None, "a", "a", "a"], "row": [9, 8, 7, 2, 1, 0]})
    assert first_alike(table).tolist() == [3, 4, 2, 3, 4, 5]
    rows = [(7, prose(1, 40), "en", "s", 1)] * 200 + [(3, prose(1, 60), "en", "s", 1)] * 3 + [(7, prose(2, 40) + " " + prose(1, 40), "en", "s", 1)] * 50 + [(None, prose(1, 40), "en", "s", 1)] * 20
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows, 13)


def test_many_copies_and_empty(spark):
    text = documents()[0][1]
    rows = [(k, text, "en", "s", 1) for k in range(60)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 13)
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_subtree_is_in_the_order_of_words():
    rng = random.Random(3)
    words = [rng.choice("abcd") for _ in range(400)]
    suffixes = np.array([["abcd".index(c) for c in words[k : k + 13]] for k in range(388)], np.uint32)
    for size in (4, 1 << 20, 1 << 30):
        tree = subtree(suffixes, size)
        rows = [tuple(suffixes[k]) for k in tree.order]
        assert rows == sorted(map(tuple, suffixes.tolist()))
        assert [next((i for i in range(13) if a[i] != b[i]), 13) for a, b in zip(rows, rows[1:])] == tree.common[1:].tolist()
        for depth in (1, 3, 13):
            assert len(tree.nodes(depth)) == len({r[:depth] for r in rows})
        shared = Counter(r[:d] for d in range(1, 14) for r in map(tuple, suffixes.tolist()))
        branching = Counter(len(p) for p, n in shared.items() if n > 1 and (len(p) == 13 or len({r[len(p)] for r in rows if r[: len(p)] == p}) > 1))
        assert tree.internal() == dict(branching)


def test_default_settings_visit_deep_nodes(spark):
    """On sf0.01 the subtrees of the operator's own homes have inner nodes of several depths and of the full one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plan = prefix_plan(docs, 13, 4)
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).withColumn("home", F.pmod("row", F.lit(7)).cast("int")).persist()
    anchors = repeated_anchors(dealt, 13, 7).toArrow()
    found = Counter()
    for home in range(7):
        blobs = [b for h, b in zip(anchors["home"].to_pylist(), anchors["answers"].to_pylist()) if h == home]
        own = Home(dealt.where(F.col("home") == home).toArrow(), _keys(blobs), 13, plan)
        found.update(own.tree().internal())
    dealt.unpersist()
    assert found[13] > 0 and sum(n for d, n in found.items() if d < 13) > found[13] and len(found) > 5
