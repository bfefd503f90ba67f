import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridion.llm.lm_scoring import CLASSES, LogBilinear, Words, classes, contexts, count_words, dealt_tokens, frequent_words, score, train
from meridion.llm.words import chunks

from .fixtures import SCHEMA, documents, lowered, prose, words_of


def test_tables_are_normalised():
    model = LogBilinear(np.array([0.5, 0.2, 0.2, 0.1]))
    one, two, b, norm = model.tables()
    for i in range(4):
        for j in range(4):
            q = model.r[i] @ model.c[0] + model.r[j] @ model.c[1]
            direct = q @ model.r.T + model.b
            assert np.allclose(one[i] + two[j] + b, direct, atol=1e-5)
            assert math.isclose(np.exp(direct - norm[i, j]).sum(), 1, rel_tol=1e-4)


def check(spark, rows):
    got = score(spark.createDataFrame(rows, SCHEMA)).collect()
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in rows]
    tokens = [[*words_of(lowered(t)), "\0end"] for _, t, *_ in rows]
    c = Counter(w for h, x in zip(held, tokens) if not h for w in x)
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for (d, *_), h, x in zip(rows, held, tokens):
        expected[d, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


@pytest.mark.parametrize("table", [0, 20, 1 << 18])
def test_base_scores(spark, monkeypatch, table):
    monkeypatch.setattr("meridion.llm.lm_scoring.frequent_words.__defaults__", (table,))
    check(spark, documents())


def test_empty_and_untrained(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
    only_held_out = [(d, "some text", "en", "s", 1) for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1]
    check(spark, only_held_out[:5])


def test_model_beats_unigrams_on_ordered_text(spark):
    rows = [(k, " ".join(["alpha beta gamma delta"] * 40) + " " + prose(k, 20), "en", "s", 1) for k in range(60)]
    got = [r for r in check(spark, rows) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_words_totals():
    w = Words((np.array([5, 9], np.uint64), np.array([3, 7]), np.array([4, 4])), 4, np.array([[4, 10, 2], [7, 2, 1]]))
    assert (w.total, w.distinct) == (16, 4)
    assert math.isclose(w.unigram.sum(), 1)
    assert w.size == 1 + CLASSES + 2 and math.isclose(w.log_class[7], math.log10(2 + 0.5 * 2)) and math.isclose(w.log_class[4], math.log10(0.5)) and w.log_class[0] == 0


def test_classes_are_of_the_last_two_bytes():
    (chunk,) = chunks(pa.array(["Walking talkinG a b A kING"]))
    own = classes(chunk).tolist()
    assert own[0] == own[1] == own[5] and own[2] == own[4] != own[3] and all(1 <= k <= CLASSES for k in own)


def test_contexts_end_at_rows():
    ids = np.array([7, 8, 9, 0, 0, 5, 0])
    one, two = contexts(ids, np.array([0, 4, 5]))
    assert one.tolist() == [0, 7, 8, 9, 0, 0, 5] and two.tolist() == [0, 0, 7, 8, 0, 0, 0]


def test_score_against_brute_force(spark):
    """The whole score by plain sums over the vocabulary, with the parameters that training gives."""
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    learned = df.withColumn("text", F.coalesce("text", F.lit(""))).where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 != 1")
    counts = count_words(learned)
    words, _ = frequent_words(counts, learned.count())
    model = train(learned, spark.sparkContext.broadcast(words), words.total)
    c = Counter(w for r in learned.collect() for w in words_of(lowered(r.text)))
    own_class = {}
    for w in c:
        (chunk,) = chunks(pa.array([w]))
        at, known = words.find(chunk.hashes(lower=True))
        own_class[w] = int(words.ids[at][0]) if known[0] else None
    mass = Counter()
    for w, n in c.items():
        mass[own_class[w]] += n + 0.5
    truth = Counter()
    for d, t, *_ in [r for r in rows if len(r[1] or "") < 3000]:
        total, before = 0.0, (0, 0)
        for w in [*words_of(lowered(t)), None]:
            if w is None:
                k = 0
            else:
                (chunk,) = chunks(pa.array([w]))
                k = own_class.get(w) or int(classes(chunk)[0])
                if k <= CLASSES:
                    total += math.log10((c[w] + 0.5) / (mass[k] + 0.5))
            q = model.r[before[0]].astype(float) @ model.c[0] + model.r[before[1]].astype(float) @ model.c[1]
            s = model.r.astype(float) @ q + model.b
            total += (s[k] - np.log(np.exp(s).sum())) / math.log(10)
            before = (k, before[0])
        truth[d, round(total / 100, 2)] += 1
    got = Counter((r.doc_id, round(r.score / 100, 2)) for r in score(df).join(df.select("doc_id", F.length("text").alias("n")).distinct(), "doc_id", "left").where("coalesce(n, 0) < 3000").collect() if r.doc_id is not None)
    assert got == Counter({k: n for k, n in truth.items() if k[0] is not None})


def test_partitions_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: (r.score, r.base_score) for r in score(docs.repartition(n)).collect()} for n in (1, 4, 32)]
    for other in found[1:]:
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for d in other for a, b in zip(found[0][d], other[d]))
    held = [d for d in found[0] if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(found[0][d][0] for d in held) > sum(found[0][d][1] for d in held) * 0.99


def test_very_many_equal_rows_are_spread(spark, monkeypatch):
    rows = [(k % 9, bytes([k % 9, 0, 0, 0])) for k in range(900)] + [(100, b"\1\0\0\0")] * 1000 + [(101, b"\2\0\0\0")] * 201
    tokens = spark.createDataFrame(rows, "key long, ids binary")
    for n_shards in (1, 7, 300):
        got = dealt_tokens(tokens.repartition(5), n_shards, 150).collect()
        assert Counter((r.key, bytes(r.ids)) for r in got for _ in range(r.n)) == Counter(rows)
        per = Counter()
        for r in got:
            per[r.shard] += r.n if r.key >= 100 else 0
        assert max(per.values()) - (min(per.values()) if len(per) == n_shards else 0) <= 2 and len(got) <= 900 + 2 * n_shards
        assert sorted(map(str, got)) == sorted(map(str, dealt_tokens(tokens.repartition(3), n_shards, 150).collect()))
    monkeypatch.setattr("meridion.llm.lm_scoring.dealt_tokens.__defaults__", (150,))
    docs = [(7, prose(1, 30), "en", "s", 1)] * 400 + [(k, prose(k, 40), "en", "s", 1) for k in range(40)]
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in score(spark.createDataFrame(docs, SCHEMA).repartition(n)).collect()) for n in (1, 9))
    assert len(a) == 440 and all(x[0] == y[0] and math.isclose(x[1], y[1], rel_tol=1e-6) for x, y in zip(a, b))


def test_very_long_text_and_clashing_names(spark):
    long = prose(5, 200_000)
    df = spark.createDataFrame([(0, long, 1.0, "x", 2), (1, "some words", 1.0, "y", 2)], "doc_id long, text string, score double, key string, held_out long")
    assert {r.doc_id: r.n_tokens for r in score(df).collect()} == {0: len(words_of(long)) + 1, 1: 3}
