"""The numbered queries: each applies its operator to its whole table and derives the columns of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import BYTE_LEVEL, PIECES, align_tokens, load_tokenizers
from .decontaminate import decontaminate
from .language import identify_language, learn_languages
from .neardup import near_duplicates
from .oracle import ORACLE  # noqa: F401
from .pieces import DEFAULT_MODEL, load_pieces, sample_encode
from .pii import replace_pii
from .quality import learn_quality, score_quality
from .rules import clean_lines
from .substrings import remove_repeats
from .toxicity import learn_toxicity, score_toxicity
from .trie import prefix_trie, rebuilt_conversations
from .warc import derive, responses_from_pages
from .windows import remove_repeated_windows

#: Of the surrogates; a deployment passes its own.
KEY = "a key for tests"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score_toxicity(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def near_duplication(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def warc_derivatives(spark, sf_dir):
    out = derive(responses_from_pages(table(spark, sf_dir, "pages"), keep=["page_id"]), keep=["page_id"])
    headers = F.to_json("source_headers")
    return out.select("page_id", "part", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "payload_digest", "block_digest", "content_length", headers.alias("source_headers"))


def line_rules(spark, sf_dir):
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_chars")


def surrogates(spark, sf_dir):
    out = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=KEY)
    return out.select("doc_id", "n_entities", "n_distinct", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn_languages(docs.where(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])


def pieces(spark, sf_dir, model_path: str = DEFAULT_MODEL):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_encode(docs, load_pieces(spark, model_path), only=["n_pieces", "ids_sha256", "lossless"], keep=["doc_id"])


def quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn_quality(docs, labels.where(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return score_quality(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def aligned(spark, sf_dir, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
    docs, files = table(spark, sf_dir, "documents").select("doc_id", "text"), load_tokenizers(spark, byte_level, pieces)
    return align_tokens(docs, files, only=["n_a", "n_b", "n_groups", "n_links", "groups_sha256"], keep=["doc_id"])


def trie(spark, sf_dir):
    return prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


def repeated_windows(spark, sf_dir):
    return remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {
    "op1_decontaminate": decontamination, "op2_toxicity": toxicity, "op3_near_duplicates": near_duplication,
    "op4_remove_repeats": repeats, "op5_warc_derivatives": warc_derivatives, "op6_line_rules": line_rules,
    "op7_pii_surrogates": surrogates, "op8_language": language, "op9_sample_pieces": pieces, "op10_quality": quality,
    "op11_align_tokens": aligned, "op12_prefix_trie": trie, "op13_repeated_windows": repeated_windows,
}
