"""The corpus pipeline: language ID, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import stored, table
from waveloom.llm.op4_pii_surrogates import key_of, redact
from waveloom.llm.op5_best_fit_packing import pack
from waveloom.llm.op6_language_id import UNKNOWN, identify
from waveloom.llm.op7_template_decontamination import leaks
from waveloom.llm.op8_minhash_dedup import one_of_each

LEAST_SCORE = 0.5
BROADCAST_IDS = 1_000_000  # leaked ids sent whole up to here, joined by shuffle above


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language or with a posterior under LEAST_SCORE.

    Null and empty texts and texts without a letter have no language and go; rows without a doc_id are judged by their text; repeated rows
    fare alike; very long texts are judged whole, a part at a time; ties go to the language first in order; without any training row nothing is recognised; an empty table stays empty; all
    columns, whatever their names, come back as they were.
    """
    kept = identify(docs, carry=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one with the smallest id, and one of rows that repeat whole.

    Null and empty texts and rows without a doc_id are near to nothing and stay; several texts of one doc_id are classed each; of copies that
    tie the smallest id stays; very long texts are compared whole; an empty table stays empty; all columns come back as they were.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item leaks into.

    Null and empty texts and rows without a doc_id stay; a doc_id goes with all its rows, repeated ones too; items that tie each count;
    very long texts are compared whole; with an empty benchmark nothing goes; an empty
    table stays empty; all columns come back as they were.
    """
    leaked = stored(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaked")
    if leaked.count() <= BROADCAST_IDS:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def surrogate_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are rewritten alike; very long texts are rewritten whole; where two kinds of entity tie, the first
    listed counts; an empty table stays empty; all other columns come back as they were.
    """
    return redact(docs, key_of(spark), count=None).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and their places in sequences.

    Null and empty texts are one piece with the end id; repeated rows are packed each; very long texts are cut into pieces; documents of one length tie and
    take their slots by rank; an empty table gives no row; other columns are ignored.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogate_pii", surrogate_pii),
    ("packing", packing),
]

#: Subword models, sketches and keyed surrogates are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
