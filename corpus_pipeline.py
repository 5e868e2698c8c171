"""The corpus pipeline: documents through quality rules, language ID, near-duplicate removal, substring dedup and packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
``docs``. All stages but the last give the columns of ``documents``.

Defined results: a null or empty text is rejected by the first stage; rows that share a doc_id count as versions of one
document and stay or go together in the third; a document without a repeated passage keeps its text as it is, else its
kept words are joined by single blanks and ``n_chars`` is counted anew; repeated rows stay repeated where they stay; very
long texts pass whole; empty tables give empty results; extra columns, whatever their names, are carried along with their
values up to the last stage, which numbers its own columns' rows (doc_id, piece, n_words, bin, start).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from tessera.llm.common import written

#: A text in a known language scores far more; texts below it have hardly any letters in common with one.
LEAST_SCORE = 0.1

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.good_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out()), "text", "lang")
    return language_id.recognised(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(docs)
    _, n_removed, kept_text = (F.col(c) for c in found.columns[-3:])
    changed = n_removed > 0
    text = F.when(changed, kept_text).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(changed, F.length(kept_text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.sized(docs))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("bins", bins)]

#: SQL can express neither the language profiles nor best-fit packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
