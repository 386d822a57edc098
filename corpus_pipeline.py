"""A training corpus in five stages: known languages, one document of each near-duplicate group, no repeated passages, sources at their weights, and token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintspan.llm import language_id, mixing, ngram_join, passage_dedup, sentencepieces
from glintspan.llm._spark import discard, stage, unused


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models, learned from the stage's own languages, don't reject.

    Null and empty texts, and those without letters, go. Null languages and ids are no hindrance: such rows are judged like
    others, and those without a language aren't learned from; all others are. Repeated rows are judged alike. No rows in,
    none out.
    """
    return language_id.identify(docs, language_id.fit(docs)).where(~F.col("lang_rejected")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates.

    Rows that repeat an id stay or go together. Rows with a null id stay, also in a group of others. Null and empty
    texts are no group's and stay. No rows in, none out.
    """
    classes = ngram_join.shingle_classes(docs)
    gone = stage(classes.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has too; those of which nothing is left go.

    n_chars is counted anew. Null and blank texts, and null ids, stay as they are. Rows that repeat an id count as
    one document. No rows in, none out.
    """
    passages = passage_dedup.repeated_passages(docs)
    blank = unused(docs, "blank_before")
    cut = passage_dedup.without_passages(docs.withColumn(blank, F.length(F.trim("text")) == 0), passages)
    kept = cut.where(F.coalesce(F.col(blank), F.lit(True)) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says.

    A null source is a source. Null and empty texts have size 0 and are emitted like others of their source; a source of
    size 0 goes. Rows that repeat an id share its draw. No rows in, none out.
    """
    return mixing.emit(mixing.mix_sources(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document taken, with digests of them and of the text that they decode to.

    A null text is as an empty one: begin and end ids only. Each row gives one row, repeated ones too; ids, languages and
    sources are passed on, null or not. No rows in, none out.
    """
    import public_tokenizers  # here, so that the other queries need no tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.encode_documents(docs, model, outputs=["n_tokens", "ids", "ids_sha256", "decoded_sha256"], keep=["doc_id", "lang", "source"])


STAGES = [("language_id", known_language), ("near_duplicates", one_of_each_group), ("repeated_passages", without_repeats), ("mix", mixed), ("tokens", tokens)]

#: Language models, similarity classes and tokens can't be told by SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again as the next one's input; each table goes when its successor is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name, heavy=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
