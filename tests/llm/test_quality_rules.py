from collections import Counter

import duckdb
import pytest

from meridion.llm.quality_rules import REPORT_SQL, line_fails, quality_filter, quality_report

from .fixtures import SCHEMA, documents, prose, words_of


def counts(text):
    words = words_of(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rows = documents()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_report(spark.createDataFrame(rows, SCHEMA)).collect())
    expected = Counter()
    for d, t, *_ in rows:
        n = counts(t)
        expected[(d, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert got == expected


@pytest.mark.parametrize("mask", [0, 3 << 40])
def test_clashing_hashes_hide_no_repeat(spark, monkeypatch, mask):
    monkeypatch.setattr("meridion.llm.quality_rules.HASH_MASK", mask)
    rows = [r for r in documents() if len(r[1] or "") < 2000]
    got = Counter((r.doc_id, r.n_repeat_words) for r in quality_report(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter((d, counts(t)[4]) for d, t, *_ in rows) and max(n for _, n in got) > 0


def test_very_long_text_and_clashing_names(spark):
    text = prose(3, 60_000)
    df = spark.createDataFrame([(1, text, 1, 2, 3)], "doc_id long, text string, _keys int, `_low` int, n_words int")
    (r,) = quality_report(df).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)


def test_oracle_agrees(spark):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in quality_report(df).collect())
    db = duckdb.connect()
    db.register("documents", df.toPandas())
    assert got == sorted(db.sql(REPORT_SQL).fetchall())


@pytest.mark.parametrize(
    ("line", "fails"),
    [("This is a clean sentence that ends well.", False), ("Licensed under the Apache License, Version 2.0.", True), ("Home | About | Contact", True), ("Menu", True), ("Well.", False), ("GO!! NOW!! BUY!! IT!! ALL!!", True), ("a*** b### c%%% d&&&", True)],
)
def test_lines(spark, line, fails):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "l string").select(line_fails(F.col("l"))).first()[0] is fails


def test_filter_cuts_lines_and_keeps_columns(spark):
    body = prose(1, 120)
    rows = [(1, body, "en", "s", 1), (2, body + "\nAll rights reserved.", "en", "s", 1), (3, "too short.", "en", "s", 1), (4, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "_q").withColumnRenamed("source", "n_words").withColumnRenamed("n_chars", "kept")
    out = quality_filter(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, body), (2, body)]
    assert quality_filter(df.limit(0)).count() == 0
