"""Ordinary tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """documents(path, stem, body, metadata VARIANT) with lang, source, n_chars, quality, toxic as typed columns too.

    Only the columns that a query uses are read and computed; without `labelled` no label is joined.
    """
    d = table(spark, sf_dir, "documents")
    if labelled:
        d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    names = ["lang", "source", "n_chars"] + ["quality", "toxic"] * labelled
    return d.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("doc_id").cast("string").alias("stem"),
        F.col("text").alias("body"), F.parse_json(F.to_json(F.struct(*names))).alias("metadata"), *names,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("metadata", F.try_parse_json("props"))
