"""The queries of this subpackage: thin applications of its operators to whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, page_text, passage_dedup, permutation_index, quality, sentencepieces, toxicity, vector_dedup
from .ngram_join import shingle_classes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    outputs = ["n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"]
    return sentencepieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=outputs)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(quality.labelled(docs, _table(spark, sf_dir, "labels"), "quality", usable=_fold(3) != 1))
    scored = quality.score(docs, forest, out_col="score")
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_text.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.round("mix_target", 6).alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_classes(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trigrams(docs)
    scorer = toxicity.fit(model, quality.labelled(docs, _table(spark, sf_dir, "labels"), "toxic", usable=_fold(4) != 2))
    scored = toxicity.score(docs, model, scorer, out_col="score")
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _fold(4) == 2)
    models = language_id.fit(docs.where(~F.col("held_out") | F.col("held_out").isNull()))
    found = language_id.identify(docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(_table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_permutation_index, op4_html_text, op5_mix_sources, op6_vector_dedup, op7_toxicity, op8_language_id, op9_ngram_join, op10_passage_dedup)}
ORACLES: dict[str, str] = {"op5_mix_sources": mixing.ORACLE}
