"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: words of training texts, cut off at ``dictionary_bytes``.
A text, in lower case, is compressed once with each dictionary and gets the language whose frame is
smallest. If that margin is narrow, a second look compresses each different word once, so that neither
repeats nor symbols decide. Equal frames go to the language whose dictionary holds more of the text's
words, then to the one with more training documents, then to the lesser name. The margin to the next
best frame gives the score; texts whose margin stays narrow are marked rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

DICTIONARY_BYTES = 32 << 10  # the most a language has
ALL_BYTES = 64 << 20  # that all dictionaries have together; many languages have smaller ones
LEAST_BYTES = 1 << 10
SAMPLE_DOCS = 100  # a language, on average: the bound on what goes into dictionaries
SAMPLE_CHARS = 4000  # of each sampled document
LEVEL = 6
NARROW = 0.02  # of the smaller frame
SLACK = 2.0  # bytes of a frame that always count as narrow
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows of which text and lang may be learned from."""
    return docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1 and text is not null and lang is not null")


def learn(docs: DataFrame) -> list[tuple[str, int, bytes]]:
    """(language, training documents, dictionary) for each language, most documents first.

    The dictionaries are made of a bounded sample: of each language's n different training texts the one of
    the least hash and those whose hash falls below SAMPLE_DOCS / n of its range (SAMPLE_DOCS of them on
    average, all if there are fewer), their first SAMPLE_CHARS characters. All documents are counted and may
    be chosen. More languages than have room for LEAST_BYTES each are refused.
    """
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = training_rows(docs).select("lang", "text", h.alias("h"))
    most = ALL_BYTES // LEAST_BYTES
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts"), F.min("h").alias("least"))
    counts = counted.orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    if not counts:
        return []
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    # At most ``most`` rows.
    limits = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, max(r.least, int(min(1.0, SAMPLE_DOCS / r.texts) * (1 << 40)))) for r in counts], "lang string, last long"))
    chosen = rows.join(limits, "lang").where(F.col("h") <= F.col("last")).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    # Copies of a text go first, so that a language's list is of SAMPLE_DOCS texts on average.
    texts = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "text"))).alias("x"))
    cut = texts.select("lang", F.substring(F.array_join(F.col("x.text"), "\n"), 1, size).alias("text"))
    content = {r.lang: r.text.lower().encode()[:size] for r in cut.collect()}
    return [(r.lang, r.n, content[r.lang]) for r in counts if r.lang in content]


class Model:
    def __init__(self, learned: list[tuple[str, int, bytes]]):
        import zstandard as zstd

        self.languages = [lang for lang, _, _ in learned]
        self.words = [frozenset(_WORD.findall(content.decode(errors="ignore").lower())) for _, _, content in learned]
        self.compress = []
        for _, _, content in learned:
            shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compress.append(zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1, and whether the margin is too narrow to be trusted."""
        if not self.languages or text is None or not _LETTER.search(text):
            return "und", 0.0, True
        text = text.lower()
        sizes = self._sizes(text)
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        if self._margin(sizes) < NARROW + SLACK / min(sizes):
            words = list(dict.fromkeys(_WORD.findall(text)))
            second = self._sizes(" ".join(words))
            hits = [sum(w in own for w in words) for own in self.words] if second.count(min(second)) > 1 else [0] * len(second)
            best = min(range(len(second)), key=lambda k: (second[k], -hits[k], sizes[k], k))
            sizes = second
        else:
            best = sizes.index(min(sizes))
        margin = (min(s for k, s in enumerate(sizes) if k != best) - sizes[best]) / sizes[best]
        return self.languages[best], min(1.0, 0.5 + margin * 2), margin < NARROW

    def _sizes(self, text: str) -> list[int]:
        data = text.encode()
        return [len(c(data)) for c in self.compress]

    @staticmethod
    def _margin(sizes: list[int]) -> float:
        a, b = sorted(sizes)[:2]
        return (b - a) / a


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row; learns from the training rows of ``docs``.

    Null texts, texts without a letter, and all texts if there is nothing to learn from get ``und`` and
    score 0. Whole texts are compressed. Repeated rows are answered once each, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))  # at most ALL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in pieces(batches):
            answers = [model.predict(t) for t in batch.column(2).to_pylist()]
            columns = zip(*answers, strict=True) if answers else ([], [], [])
            columns = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
