"""The opN_<name> queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, chat, divergence, langid, line_dedup, lm, merkle, mixing, simhash, sketch, toxicity, warc
from quern.llm.work import table


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the doc_id as text, modulo ``by``; null for null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_fold = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs.where(~out_of_fold))
    return langid.predict(docs, model).select("doc_id", out_of_fold.alias("held_out"), "lang_pred", "score")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_fold = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out_of_fold))
    return toxicity.score(docs, machine).select("doc_id", out_of_fold.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link(table(spark, sf_dir, "documents"))
    digits = F.lower(F.hex("fp"))
    return out.select("doc_id", F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)]).alias("fingerprint"), "component_id")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_fold = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    model = lm.Trained(docs.where(~out_of_fold).select("text"), lm.input_bytes(docs))
    return model.score(docs).withColumn("held_out", out_of_fold)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_trial(table(spark, sf_dir, "conversations"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_document_fingerprints, op3_bpe_codec, op4_toxicity, op5_mix_sources, op6_simhash_links, op7_lm_scores, op8_line_dedup, op9_nearest_vectors,
        op10_warc_round_trip, op11_chat_formatting, op12_source_divergence, op13_merkle_manifest,
    )
}
ORACLES = {
    "op5_mix_sources": mixing.MIX_SQL, "op8_line_dedup": line_dedup.LINES_SQL, "op10_warc_round_trip": warc.WARC_SQL, "op11_chat_formatting": chat.CHAT_SQL,
    "op12_source_divergence": divergence.AUDIT_SQL, "op13_merkle_manifest": merkle.manifest_sql(),
}
