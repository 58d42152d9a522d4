"""A training corpus in five stages; each one works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultql.llm.common import discard, written
from vaultql.llm.decontaminate import decontaminate
from vaultql.llm.language import identify_language, learn_languages
from vaultql.llm.neardup import near_duplicates
from vaultql.llm.pieces import DEFAULT_MODEL, load_pieces, sample_encode
from vaultql.llm.pii import replace_pii
from vaultql.llm.queries import KEY, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stands out; lang is the one that was found."""
    found = identify_language(docs.select(*COLUMNS), learn_languages(docs))
    return found.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; ids are unique in `documents`.

    Shingles have five words here, the rule for stages; the query op3_near_duplicates has its own contract, with two.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where("NOT contaminated").select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced by surrogates."""
    return replace_pii(docs, key=KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All documents as sampled pieces."""
    return sample_encode(docs, load_pieces(spark, model_path), only=["ids", "n_pieces", "lossless"], keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", by_language), ("MinHash near-dedup", without_near_duplicates), ("benchmark decontamination", without_benchmarks),
    ("PII", without_pii), ("SentencePiece encoding and decoding", in_pieces),
]

#: SQL has neither the language model, nor the surrogates, nor the sampled pieces: tests/llm tests the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage written to the shared folder and read back for the next one."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            discard(before)  # its rows are in the next stage's table
        before = docs
    return docs
