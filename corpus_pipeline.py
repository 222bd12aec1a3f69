"""The document pipeline: five stages, each a document operator over all that the stage before it kept.

toxicity (rejected documents go) -> n-gram Jaccard join (one document of each class stays) -> PII (spans are replaced by their
kind) -> mixing to target weights (documents repeat or drop out) -> best-fit packing (one row per piece with its place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import jaccard_join, mixing, packing, pii_crf, toxicity
from trackloom.llm.common import held_out, materialize
from trackloom.llm.queries import THRESHOLD, WORD_TOKENIZER

#: SQL cannot express the models: the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learned from the labels outside op3's held-out part."""
    model = toxicity.fit_toxicity(docs.where(~held_out(F.col("doc_id"), 3, 1)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where(F.col("toxic_score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    out = pii_crf.redact_documents(docs, pii_crf.train())
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_copies), ("pii", redact), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
