"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import ann, chat_format, decontaminate, jaccard_join, language_id, license_scan, pieces, pii, sharding, url_filter
from tesserae.llm.common import table
from tesserae.llm.oracles import ORACLES as ORACLES

RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontaminate.match_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The model file of the tokenizer; a path, as vocabularies aren't part of the repository.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(spark, table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")


SHARDS = 16


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{CONTROL_TEXT}'), (-1L, 1L, 'assistant', '{CONTROL_TEXT}') t(conv_id, turn, role, text)")
    out = chat_format.format_trees(spark, chat_format.turns_to_messages(rows.unionByName(extra)), unique=True)
    turns = chat_format.read_turns(F.col("formatted"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: In production the key comes from a secret store; results have to be the same from run to run here.
PII_KEY = "surrogates for the registered query"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replacements(table(spark, sf_dir, "documents"), PII_KEY)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("families", ",").alias("families"), "n_passages", "score", "similarity")


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_pii": op8_pii,
    "op9_license_scans": op9_license_scans,
    "op10_approximate_nearest_neighbours": op10_approximate_nearest_neighbours,
}
