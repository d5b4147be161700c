"""Corpus cleaning pipeline over ``documents``: five stages, each a training-data operator.

A stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and returns
a frame; all but the last keep the columns of ``documents``.  ``run`` writes each stage's rows
as Parquet into the shared scratch folder and reads them back for the next.

Defined cases, in every stage: null and empty texts have no language and go with the first stage
(later stages, given them, keep them); rows without an id take part under a number made from their
text; rows of one id are one document; ties go to the smaller id; very long texts are worked off
whole; extra columns of any name pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.llm import bpe, decontam, language, near_dedup, window_dedup
from tallyrake.llm.common import keyed, staged, table

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; without letters or ambiguous ones go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (5 words, similarity 0.8 or more).

    Documents without words are no copies of each other and stay; of rows with one id one stays."""
    return near_dedup.keep_one(docs, percent=80)


def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words under 13-word windows of earlier documents; documents left without a word go,
    untouched texts stay as they are."""
    rows = keyed(docs, "doc_id", "text")
    cut = (window_dedup.dedup_windows(rows, "id", "text", only_hits=True)
           .select("id", "text_hash", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
           .dropDuplicates(["id", "text_hash"]))
    joined = (rows.select("row", "id", F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
              .join(cut, ["id", "text_hash"], "left").filter("n_removed is null or n_removed < n_words"))
    new = {"text": F.coalesce("kept", F.col("row.text")),
           "n_chars": F.coalesce(F.length("kept").cast("long"), F.col("row.n_chars"))}
    return joined.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_counts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: ids, token counts and digests."""
    out = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_windows", repeated_windows),
          ("benchmark_overlaps", benchmark_overlaps), ("token_counts", token_counts)]

#: Learned classifiers, components and byte-pair merges can't be said in SQL; tests/llm holds
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
