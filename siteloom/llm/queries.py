"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import bpe, divergence, interaction, jaccard, licenses, mixture, neighbours, personal, phrases, quality, secrets, toxicity, warc
from siteloom.llm.common import table


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return quality.judge(table(spark, sf_dir, "documents")).select(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def vocabulary(spark: SparkSession) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern, digests=True)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload", "url")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard, "op4_nearest_neighbours": op4_nearest_neighbours, "op6_warc": op6_warc, "op1_secret_scan": op1_secret_scan, "op5_license_scan": op5_license_scan, "op5_license_notices": op5_license_notices, "op10_personal_data": op10_personal_data, "op3_byte_bpe": op3_byte_bpe, "op2_toxicity": op2_toxicity, "op9_quality_rules": op9_quality_rules, "op8_mix_sources": op8_mix_sources, "op11_filter_interaction": op11_filter_interaction, "op12_source_divergence": op12_source_divergence, "op13_phrase_fingerprint": op13_phrase_fingerprint}
SQL = {"op1_secret_scan": secrets.sql(), "op5_license_scan": licenses.sql(), "op11_filter_interaction": interaction.sql(), "op12_source_divergence": divergence.sql()}
