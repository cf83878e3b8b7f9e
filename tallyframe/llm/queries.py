"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import conversation_repair, embed_dedup, langid, licenses, media, merkle, mixing, ngram_join, orc_tokens, pieces, pii, quality, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampling_plan(_docs(spark, sf_dir))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.piece_digests(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return orc_tokens.token_files(spark, _docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(_docs(spark, sf_dir)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_docs(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_docs(spark, sf_dir))


def op7_wav_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_docs(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = langid.id_remainder("doc_id", 3) == 1
    model = quality.fit(docs, quality.label_rows(labels.where(~held), "quality"))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = langid.id_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, quality.label_rows(labels.where(~held), "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(_docs(spark, sf_dir)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checks_out(_docs(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(*conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pieces": op2_pieces,
    "op3_orc_tokens": op3_orc_tokens,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_wav_media": op7_wav_media,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_embed_dedup": op10_embed_dedup,
    "op11_licenses": op11_licenses,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.plan_sql(),
    "op11_licenses": licenses.digests_sql(),
    "op12_merkle_manifest": merkle.checks_sql(),
    "op13_conversation_repair": conversation_repair.report_sql(),
}
