import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from meridion.llm.language_id import identify, learn

from .fixtures import SCHEMA, documents

EN = "the quick brown fox jumps over the lazy dog while the rain keeps falling on the quiet house near the river and nobody minds it"
DE = "der schnelle braune fuchs springt ueber den faulen hund waehrend der regen weiter auf das stille haus am fluss faellt und niemand stoert sich daran"


def test_held_out_accuracy(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(300):
        lang, words = (("en", EN), ("de", DE))[k % 2]
        rows.append((k, " ".join(rng.choices(words.split(), k=40)), lang, "s", 1))
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [(k, lang) for k, _, lang, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k, _ in held)
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_rows(spark):
    rows = documents() + [(5000, "123 456 !!!", "en", "s", 1)]
    got = identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5000].lang_pred == "und" and by[5000].score == 0
    assert all(r.lang_pred in ("en", "fr", "und") for r in got)
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 1)], SCHEMA)
    assert [r.lang_pred for r in identify(unlabelled).collect()] == ["und"]


def test_against_brute_force(spark):
    """Where frames differ clearly, the language is the one whose dictionary gives the least frame, each compressed anew here."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.lit("clash"))
    learned = learn(df)
    assert {name for name, *_ in learned} == {r.lang for r in df.where("lang is not null").select("lang").distinct().collect()}
    texts, got = {r.doc_id: r.text for r in df.collect()}, {r.doc_id: r for r in identify(df).collect()}
    clear = 0
    for d, text in texts.items():
        if text is None or not any(c.isalpha() for c in text):
            assert got[d].lang_pred == "und"
            continue
        sizes = {}
        for name, _, content in learned:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = len(zstandard.ZstdCompressor(level=6, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.lower().encode()))
        best, second = sorted(sizes.values())[:2]
        if second - best > 0.1 * best + 10:
            clear += 1
            assert got[d].lang_pred == min(sizes, key=sizes.get)
    assert clear > 500


def test_held_out_accuracy_on_the_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    n, right = joined.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right >= 0.97 * n


def test_many_languages_share_the_room(spark, monkeypatch):
    monkeypatch.setattr("meridion.llm.language_id.ALL_BYTES", 40 << 10)
    rows = [(k, f"wort{k % 30}x " * 400, f"l{k % 30}", "s", 1) for k in range(300)]
    learned = learn(spark.createDataFrame(rows, SCHEMA))
    assert len(learned) == 30 and all(len(content) <= (40 << 10) // 30 for *_, content in learned)
    with pytest.raises(ValueError, match="languages"):
        learn(spark.createDataFrame([(k, "x", f"l{k}", "s", 1) for k in range(300)], SCHEMA))


def test_copies_of_one_row_are_learned_from_once(spark):
    rows = [(0, "immer wieder der gleiche text", "de", "s", 1)] * 500 + [(1, "the same text again", "en", "s", 1)] * 3
    learned = {name: (n, content) for name, n, content in learn(spark.createDataFrame(rows, SCHEMA))}
    assert learned == {"de": (500, b"immer wieder der gleiche text"), "en": (3, b"the same text again")}
