import base64
import hashlib
import random
import time
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from meridion.llm.byte_bpe import ByteBPE, decode_ids, encode_documents
from meridion.llm.token_counts import Frequent, LengthTable, count_tokens, frequent_words
from meridion.llm.words import chunks

from .fixtures import SCHEMA, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "\x00\x01", "don't 'S 's", " " * 50, "x" * 3000, "ab" * 4000, "<|endoftext|> <|startoftext|>x", "İΣ ǅ", "é ́x", "\r\n\x0b\x0c\x85  end", "12345 6.7"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segment_tree_equals_library(library):
    bpe = ByteBPE(RANKS, public_tokenizers.PATTERN)
    texts = ODD + [t or "" for _, t, *_ in documents()]
    found = list(bpe.encode_batch(texts))
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(ids).decode() for ids in found] == texts


def test_trees_of_long_pieces(library, monkeypatch):
    """Each kind of tree gives the library's ids for pieces of all lengths, whichever kind is used."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 400))) for alphabet in ("ab", "abc ", "etaoinshr", "üöäß", " ", "=-", "\U00010280\u4e2d") for _ in range(40)]
    truth = [library.encode_ordinary(t) for t in texts]
    for least in (2, 64, 1 << 30):
        monkeypatch.setattr("meridion.llm.byte_bpe.LONG_PIECE", least)
        assert list(ByteBPE(RANKS, public_tokenizers.PATTERN).encode_batch(texts)) == truth


@pytest.mark.parametrize("size", [(1 << 20) - 1, 1 << 20, (1 << 20) + 1, 3 << 20])
def test_pieces_of_over_a_mebibyte(library, size):
    bpe = ByteBPE(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(size)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(size))
    texts = [letters, " " * size, "\U00010280" * (size // 4) + "überallwordsandletters" * 3]
    began = time.time()
    found = list(bpe.encode_batch(texts))
    assert time.time() - began < 120
    for text, ids in zip(texts, found):
        # The library's own pattern engine overflows on such pieces, so they are handed to it one by one.
        assert ids == [i for piece in bpe.find(text) for i in library._encode_single_piece(piece.encode())] and bpe.decode(ids).decode() == text


def test_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("meridion.llm.byte_bpe.CACHE_PIECES", 3)
    bpe = ByteBPE(RANKS, public_tokenizers.PATTERN)
    for text in ["some words here", "some other words there", "überall words"]:
        assert list(bpe.encode_batch([text])) == [library.encode_ordinary(text)]


def test_encode_documents(spark, library):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "ids")
    out = encode_documents(df, RANKS, public_tokenizers.PATTERN, with_ids=True)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    expected = Counter()
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        expected[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected
    back = decode_ids(out, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t, *_ in rows)
    assert encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_count_tokens(spark):
    rows = documents() + [(2000 + k, t, "en", "s", 1) for k, t in enumerate(ODD)]
    library = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame(rows, SCHEMA)
    for table in (8, 1 << 16):
        got = Counter(tuple(r) for r in count_tokens(df, WORDS, limit=100, table_words=table).collect())
        n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
        assert got == Counter((d, len((t or "").encode()), k, k > 100) for (d, t, *_), k in zip(rows, n))
    assert count_tokens(df.limit(0), WORDS).count() == 0


def test_length_table_probes():
    import numpy as np

    keys = np.arange(1, 2001, dtype=np.uint64) << np.uint64(50)  # many share a slot
    keys[1000:] = np.arange(1000, dtype=np.uint64)
    lengths = np.arange(1, 2001).astype(np.uint16)
    table = LengthTable(keys, lengths)
    expected = dict(zip(keys.tolist(), lengths.tolist()))
    assert all(expected.get(k) is not None for k in keys.tolist())
    found = table.find(np.array(list(expected), np.uint64))
    first = {}
    for k, n in zip(keys.tolist(), lengths.tolist()):
        first.setdefault(k, n)
    assert found.tolist() == [first[k] for k in expected]
    assert table.find(np.array([12345 << 40], np.uint64)).tolist() == [0]


def test_table_is_chosen_from_all_documents(spark, monkeypatch):
    """Words of the last partition are in the table as well as those of the first, and forgetting changes no count."""
    monkeypatch.setattr("meridion.llm.token_counts.HELD_WORDS", 64)
    rows = [(k, f"part{k // 50} " * 30 + f"rare{k}", None, None, None) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(8, "doc_id")
    assert {f"part{k}".encode() for k in range(4)} == set(frequent_words(df, 8)) and frequent_words(df, 3) == []
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, WORDS, table_words=2).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t, *_ in rows}


def test_counts_of_frequent_words():
    own, truth = Frequent(), Counter()
    rng = random.Random(4)
    for _ in range(20):
        text = " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(500)) + " " + "x" * 65
        own.add(next(chunks(pa.array([text]))))
        truth.update(w.encode() for w in text.split() if len(w) <= 64)
    counts, words = own.merge(1 << 18)
    assert dict(zip(words.tolist(), counts.tolist())) == truth
    counts, words = own.merge(5)
    assert sorted(counts.tolist()) == sorted(truth.values())[-5:] and all(truth[w] == n for w, n in zip(words.tolist(), counts.tolist()))


def test_words_of_any_length(spark):
    text = "y" * 300_000 + " " + "z" * 70 + " " + "z" * 70
    df = spark.createDataFrame([(1, text, "a", "b", 1)], "doc_id long, text string, n_tokens string, key string, n_bytes long")
    (row,) = count_tokens(df, WORDS).collect()
    assert row.n_tokens == len(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids) and row.n_bytes == len(text)
