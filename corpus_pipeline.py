"""A training corpus in stages; each stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm import exact_dedup, language, ngram_join, packing
from trainlake.llm.common import carried, col, free_names, prepared, table, written

#: A document whose likeliest language has less than this probability is rejected.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: without a letter, or below ``MIN_SCORE``,
    they go. Columns stay as they are. Without labelled documents there is no model to reject any,
    and all stay."""
    prepared(spark)
    model = language.fit(docs)
    if not model.languages:
        return docs
    lang, score = free_names(docs, "lang_pred", "score")
    labelled = language.predict(docs, model, prediction=lang, score=score)
    return labelled.filter((col(lang) != language.UNKNOWN) & (col(score) >= MIN_SCORE)).select(*map(col, docs.columns))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, one with the largest id."""
    prepared(spark)
    return exact_dedup.keep_one_of_each(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; those
    without an id come last.

    Every row is numbered and written once, and rows are compared and kept by that number: rows that
    share an id have each their own group, and so do rows without one."""
    prepared(spark)
    rows = written(carried(docs, number=F.monotonically_increasing_id()), "numbered-rows")
    groups = ngram_join.jaccard_components(rows.select(F.col("number").alias("doc_id"), "row.text"))
    ids = rows.select("number", F.col("row.doc_id").alias("id"))
    members = groups.join(ids, F.col("doc_id") == F.col("number")).select("component_id", F.struct(F.col("id").isNull().alias("last"), "id", "number").alias("place"))
    first = members.groupBy("component_id").agg(F.min("place").alias("place")).select("place.number")
    return rows.join(first, "number", "left_semi").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
