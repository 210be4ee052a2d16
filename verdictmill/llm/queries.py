"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, hard_negatives, html_text, kneser_ney, line_dedup, mixing, near_dedup, packing, pii, token_counts, whitening
from .common import table
from .oracles import SQL


#: Of the registered query alone; who publishes a corpus passes a secret.
DEMONSTRATION_KEY = b"verdictmill demonstration"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated sentences; what was removed is told as start:length:keep_id in the original text."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), unit="sentence", min_words=line_dedup.SENTENCE_WORDS, run_words=line_dedup.RUN_WORDS)
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"), s["keep_id"].cast("string"))), " "))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    ids = F.col("ids")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), spans=False).select("doc_id", "ids", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"))
    return byte_bpe.decode(encoded, keep=("doc_id", "n_tokens", "ids_sha256"), text=False).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label="if(vec_id % 7 = 0, (label + 1) % 10, label)")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_main_text, op3_ann, op4_kneser_ney, op5_exact_dedup, op6_mixing, op7_near_dedup, op8_token_counts, op9_packing, op10_line_dedup, op11_byte_bpe, op12_hard_negatives, op13_whitening)}
ORACLES = SQL
