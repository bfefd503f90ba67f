import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from meridion.llm import quality_rules as rules
from meridion.llm.pii import Pseudonyms, session_key

from .fixtures import SCHEMA, documents, prose, words_of
from .test_quality_rules import counts
from .test_simhash import kept_by_brute_force

LEAK = prose(700, 40)


def line_stays(line):
    words = words_of(line)
    if not words:
        return True
    packed = "".join(words)
    symbols, shouts = len(re.findall(rules.SYMBOLS, line)), len(re.findall("[!?]", line))
    boilerplate = len(line) <= rules.BOILERPLATE_CHARS and re.search(rules.BOILERPLATE, line, re.I)
    navigation = len(words) <= rules.NAV_WORDS and re.search(rules.NAVIGATION, line)
    unfinished = len(words) < rules.FEW_WORDS and not re.search(rules.ENDING, line)
    return not (boilerplate or navigation or unfinished or symbols * 10 > len(packed) or shouts * 2 > len(words) + 4)


def kept_text(text):
    n_words, chars, _, _, repeats = counts(text)
    if n_words < rules.MIN_WORDS or 100 * repeats > rules.MAX_REPEAT_PERCENT * n_words:
        return None
    clean = "\n".join(x for x in text.split("\n") if line_stays(x))
    return clean if 100 * sum(map(len, words_of(clean))) >= rules.KEPT_PERCENT * chars else None


def brute(rows, key):
    """What may come out for each group of near copies: a set of (doc_id, tokens, digest) of which one does, or of nothing if it leaks."""
    rows = [(d, kept_text(t)) for d, t, *_ in rows if t is not None]
    rows = [r for r in rows if r[1] is not None]
    leak = [w.lower().strip(".") for w in LEAK.split()]
    grams = {tuple(leak[i : i + 8]) for i in range(len(leak) - 7)}
    own = Pseudonyms(key)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for group in kept_by_brute_force(rows):
        ways = set()
        for d, t in (rows[k] for k in group):
            w = [x.lower().strip(".") for x in t.split()]
            if sum(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7)) >= 6:
                ways.add(None)
                continue
            ids = library.encode_ordinary(own.replace(t)[0])
            ways.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
        out.append(ways)
    return out


def test_run_against_brute_force(spark, tmp_path):
    extra = [
        (2001, prose(701, 90) + " " + LEAK + " " + prose(702, 30), "en", "s", 1), (2002, prose(703, 120) + " mail joe@example.org or 4111111111111111 today.", "en", "s", 1),
        (2003, prose(704, 150) + "\nAll rights reserved.", "en", "s", 1), (2004, prose(704, 150), "en", "s", 1),
        # Rows that share a doc_id but not their text, rows without one, and a copy of another row under an id that is used.
        (2003, prose(705, 130), "en", "s", 1), (2003, prose(706, 130), "en", "s", 1), (None, prose(707, 130), "en", "s", 1), (None, prose(708, 130), "en", "s", 1), (2003, prose(703, 120) + " mail joe@example.org or 4111111111111111 today.", "en", "s", 1),
    ]
    rows = [*documents(), *extra]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    truth = brute(rows, session_key(spark))
    for ways in truth:
        assert sum(got[w] for w in ways if w is not None) == (1 if None not in ways else 0)
    assert sum(got.values()) == sum(None not in ways for ways in truth)
    ids = Counter(d for d, *_ in got.elements())
    assert 2001 not in ids and ids[2002] == 1 and 2004 not in ids and ids[2003] == 3 and ids[None] >= 2
    assert ids[5] + ids[14] == 1  # they are 0.98 alike


def test_stages_keep_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(documents(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
