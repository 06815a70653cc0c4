"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Language ID drops documents that no language is predicted for, or none with a score of ``LEAST_SCORE``, near-dedup keeps the document with the smallest id of
each group (by the hash of their texts where an id repeats; documents without an id come last), span dedup removes repeated sentence spans (and documents of which nothing is left), decontamination
drops documents with benchmark passages, and encoding returns the token counts and hashes of what remains.

Every stage keeps rows of equal id and text together, carries extra columns and works on empty tables; a null text has no language and
goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, phrases, simhash, spans
from tidemark.llm.common import crc_bucket, store, table
from tidemark.llm.queries import tokenizer_file

#: Documents whose most likely language is less likely than this go.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inputs = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("lang"), F.col("text"))
    training = crc_bucket(F.col("doc_id"), 4) != 2
    found = langid.identify(inputs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), training)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text.alias("text"))
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.id").alias("_id"), F.col("doc_id.text").alias("_text")).distinct()
    # the keys of a partition are hashed and the texts stream past them, unsorted
    return docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["_id"]) & (text == keep["_text"]), "left_semi")


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inputs = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    found = spans.dedup_spans(inputs)
    found = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[{"text": F.col("text"), "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inputs = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return phrases.flag(inputs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", span_dedup),
    ("benchmark decontamination", decontamination),
    ("bpe encoding", encoding),
]

#: Fingerprint components and language models are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
