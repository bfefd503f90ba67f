"""The subpackage's queries: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_documents
from .decontaminate import contamination
from .html_extract import extract
from .language_id import identify
from .lm_scoring import score
from .pii import pseudonym_report, session_key
from .quality_rules import REPORT_SQL, quality_report
from .simhash import near_duplicates
from .substring_dedup import deduplicate
from .tables import read_table
from .token_counts import count_tokens


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(read_table(spark, sf_dir, "documents"), session_key(spark))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), enough=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_pii, op4_html_extraction, op5_quality_rules, op6_byte_bpe, op7_decontamination, op8_simhash, op9_token_counts, op10_language_id)}
ORACLE: dict[str, str] = {"op5_quality_rules": REPORT_SQL}
