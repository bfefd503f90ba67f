"""The corpus pipeline over ``documents``: quality rules, near-dedup, decontamination, pseudonyms, token ids.

A stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents. The quality stage also cuts failing lines
out of the texts it keeps; the last stage returns each text's ids and digests.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridion.llm.byte_bpe import encode_documents
from meridion.llm.decontaminate import drop_contaminated
from meridion.llm.pii import pseudonym_stage, session_key
from meridion.llm.quality_rules import quality_filter
from meridion.llm.simhash import keep_one
from meridion.llm.tables import discard, read_table
from meridion.plans.session import shared_dir, ship_package

ORACLE_SQL = None  # byte-level BPE and fingerprints can't be said in SQL; tests/llm/test_pipeline.py holds run() against brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pseudonym_stage(docs, session_key(spark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read from there.

    A stage's table goes once the next one is written; the last one stays, as the result is read from it. Null and
    empty texts fail the quality rules. Rows are judged one by one, without a doc_id and with a repeated one too;
    of near copies, repeated rows included, one stays. An empty table gives no rows; other columns are handed on up
    to the last stage, whatever their names. Texts may be of any length.
    """
    docs, before = read_table(spark, sf_dir, "documents"), ""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{name}")
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
