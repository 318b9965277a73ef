"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, alignment, decontaminate, language_id, license_scan, merkle, mixing, ngram_join, perspectives, quality_rules, token_binary, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6)).drop("text_hash")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives.perspectives(_table(spark, sf_dir, "conversations"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("+"), s["length"].cast("string"))), " ")
    return views.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), "first_turn", "n_turns", "first_char", "text", listed.alias("spans"), "mask_chars")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.language_id(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed_sources(_table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "block_order", "doc_order")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(_table(spark, sf_dir, "pages")).drop("intact")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered, digests=True)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1,
    "op2_token_binary": op2,
    "op3_quality_rules": op3,
    "op4_decontamination": op4,
    "op5_perspectives": op5,
    "op6_ngram_jaccard": op6,
    "op7_language_id": op7,
    "op8_license_scan": op8,
    "op9_source_mixing": op9,
    "op10_warc_revisits": op10,
    "op11_quality_classifier": op11,
    "op12_merkle_manifest": op12,
    "op13_token_alignment": op13,
}
