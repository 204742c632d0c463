"""A corpus pipeline over `documents`: language ID, near duplicates, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of `documents`. run() writes each stage's result to the shared folder and
rereads it, so a lost executor costs one stage's rereading at most.

Defined results: a text that is null or has no letter goes with the first stage (all do, where no document has a
label to learn from); the other stages keep such rows, which have no words, entities or tokens (null ids for a null text). Of
linked documents the smallest id stays, and of repeated rows of one id the least text; rows without an id stay, unless they
are linked with a row that has one, or with each other. Very long texts are worked on whole. An empty table gives no
rows, and an empty benchmark cuts nothing. Other columns of any name go, and the order of columns doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, jaccard_join, language_id, pieces, pii
from tesserae.llm.common import Scratch, table
from tesserae.llm.queries import PII_KEY, SENTENCEPIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; every other has a language."""
    return language_id.keep_known(spark, docs).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a Jaccard similarity of 0.8 or more, the smallest id stays."""
    return jaccard_join.keep_one(spark, docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go."""
    kept = decontaminate.remove_contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return _measured(kept)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    return _measured(pii.anonymise(docs, PII_KEY))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's pieces, checked by decoding."""
    out = pieces.encode(spark, docs, SENTENCEPIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_pii),
    ("sentencepiece", tokens),
]

#: SQL can express neither the trained classifier nor the keyed surrogates. tests/llm/test_pipeline.py holds every stage and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
