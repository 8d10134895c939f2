"""Exact duplicates: cases beyond the table."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from trainlake.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, keep_id long, kept string"


def answered(spark, docs, **options):
    df = spark.createDataFrame([(d, t, "x", 0, "y") for d, t in docs], SCHEMA).repartition(4)
    got = exact_dedup.dedup_exact(df, **options).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str)


def expected(docs):
    out, seen = [], set()
    for d, t in docs:
        same = [e for e, u in docs if (u or "") == (t or "")]
        ids = [e for e in same if e is not None]
        keep = max(ids) if ids else None
        first = d == keep and (keep, t or "") not in seen
        if first:
            seen.add((keep, t or ""))
        out.append((d, keep, len(same), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


DOCS = [(1, "a"), (2, "a"), (3, "A"), (4, ""), (5, None), (6, " a"), (7, "b" * 300_000), (8, "b" * 300_000), (8, "b" * 300_000), (None, "a"), (None, "c"), (None, "c"), (9, "é"), (10, "é")]


def test_cases(spark):
    assert answered(spark, DOCS) == expected(DOCS)
    assert answered(spark, []) == []


def test_different_texts_of_one_digest(spark, monkeypatch):
    """With a digest that is the same for all texts, and with both hashes the same."""
    assert answered(spark, DOCS, digest=lambda text: F.substr(text, F.lit(1), F.lit(0)), salts=2) == expected(DOCS)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert answered(spark, DOCS, digest=lambda text: F.substr(text, F.lit(1), F.lit(0))) == expected(DOCS)


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(d, t, "x", d, "y") for d, t in DOCS if d != 8], SCHEMA)
    got = exact_dedup.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id) == [2, 3, 5, 6, 7, 9, 10]


def test_repeated_rows_and_rows_without_an_id(spark):
    """One row of each text stays: of a row delivered often, and of a text that has no id."""
    docs = DOCS + [(20, "often")] * 50 + [(None, "no id")] * 50 + [(None, None), (21, "no id")]
    df = spark.createDataFrame([(d, t, "x", k, "y") for k, (d, t) in enumerate(docs)], SCHEMA).repartition(4)
    got = exact_dedup.keep_one_of_each(df)
    assert got.columns == df.columns
    rows = sorted(((r.doc_id or 0, (r.text or "")[:5]) for r in got.collect()))
    assert rows == [(0, "c"), (2, "a"), (3, "A"), (5, ""), (6, " a"), (8, "bbbbb"), (9, "\u00e9"), (10, "e\u0301"), (20, "often"), (21, "no id")]


def test_hot_text_is_combined_before_the_shuffle(spark):
    """A third of all rows has one text; only a few rows of it leave the tasks."""
    df = spark.range(30_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    plan = exact_dedup.winners(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Python" not in plan
    got = exact_dedup.dedup_exact(df).filter("text_sha256 = sha2('hot', 256)")
    assert got.agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("group_size")).first() == (10_000, 1, 10_000)
