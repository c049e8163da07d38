"""The training-data pipeline: documents through five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwalk.llm import decontaminate, line_dedup, minhash_dedup, quality_cnn, sentencepiece_fst
from layerwalk.llm.common import drop_stage, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least its threshold)."""
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score_texts(docs, net).filter(F.col("score") >= quality_cnn.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others repeat; n_chars follows the text."""
    done = line_dedup.drop_lines(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows repeated under one id the one with the smallest text stays; every row without an id stays.
    """
    names = docs.columns
    kept = minhash_dedup.near_duplicates(docs).filter("kept").select("doc_id")
    out = docs.join(kept, "doc_id", "left_semi").select(*names)
    often = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if not often.isEmpty():
        one = out.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in names if c != "text"))).alias("row"))
        out = out.join(often, "doc_id", "left_anti").select(*names).union(one.select("row.*").select(*names))
    return out.union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size and digests of each document's pieces, and whether they decode to its text."""
    return sentencepiece_fst.digest(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", tokens),
]
#: SQL cannot express the classifier and the pieces; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder, read again and deleted once the next one is written.

    What the last one reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            drop_stage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
