"""Corpus pipeline: language, lines, near copies, benchmark leaks, tokens; one table of documents after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, language, leaks, lines, near
from larkspur.llm.common import Stage, documents, release, results

#: Some stages learn or are exact procedures that SQL can't state; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (null, no letters) or with an unclear one go."""
    plain = docs.select(*[c for c in docs.columns if c not in language.RESULTS])
    return language.identify(plain, language.train(docs)).where("NOT ambiguous").select(*plain.columns)


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of templates that recur across documents go; n_chars follows the text."""
    cut = lines.drop_templates(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group of near copies stays."""
    return near.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of the benchmark go."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: sizes and digests of the ids of what is left."""
    return bpe.digests(docs.select("doc_id", "text", "source")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", without_templates),
    ("near_dedup", one_of_each),
    ("decontamination", without_leaks),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    with Stage(spark) as stage:
        for k, (_, apply) in enumerate(STAGES):
            held = results()
            docs = stage.cut(apply(spark, docs, sf_dir), keep=k + 1 == len(STAGES))
            # What the stage was made of has been read.
            release(results() - held)
            if before is not None:
                stage.drop(before)
            before = docs
    return docs
