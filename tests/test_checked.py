"""Checked writes, zone maps and distinct counts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trainlake.operators import metrics
from trainlake.plans import gold
from trainlake.plans.lake import Lake
from trainlake.sources import checked as ck
from trainlake.sources import commits, readers, writers, zones


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id LONG, name STRING, size INT")


RULES = [ck.not_null("name"), ck.within("size", 0, 9), ck.Rule("even", "id % 2 = 0", tolerance=0.5)]


def test_bad_rows_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "t")
    report = ck.commit_checked(table(spark, (2, "a", 1), (4, None, 99), (6, "b", None), (7, "c", 3)), path, RULES, unique=["id"])
    assert (report.rows, report.aside, report.commit.rows) == (4, 2, 2)
    assert report.broken == {"name is there": 1, "size from 0 to 9": 1, "even": 1}
    assert sorted(r.id for r in commits.read_committed(spark, path).collect()) == [2, 6]
    aside = {r.id: r.broken_rules for r in ck.read_quarantine(spark, path, report.name).collect()}
    assert aside == {4: ["name is there", "size from 0 to 9"], 7: ["even"]}
    ck.commit_checked(table(spark, (8, "d", 2)), path, RULES)
    assert commits.read_committed(spark, path).count() == 3 and ck.read_quarantine(spark, path).count() == 2


def test_refused_loads_publish_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ck.Refused, match="2 of 3 rows break the rule: even") as fault:
        ck.commit_checked(table(spark, (1, "a", 1), (2, "b", 1), (3, "c", 1)), path, RULES)
    assert fault.value.report.broken["even"] == 2
    assert sorted(r.id for r in ck.read_quarantine(spark, path, fault.value.report.name).collect()) == [1, 3]
    with pytest.raises(ck.Refused, match="not unique, for example"):
        ck.commit_checked(table(spark, (2, "a", 1), (2, "b", 1)), path, RULES, unique=["id"])
    with pytest.raises(ck.Refused, match="0 good rows, of 1 at least"):
        ck.commit_checked(table(spark, (2, "a", 1)).limit(0), path, RULES)
    with pytest.raises(ValueError, match="breaks its contract"):
        ck.commit_checked(table(spark, (2, "a", 1)), path, RULES, contract="id STRING")
    with pytest.raises(RuntimeError, match="no commit"):
        commits.read_committed(spark, path)
    commits.vacuum(spark, path, dt.timedelta(0))
    with pytest.raises(RuntimeError, match="nothing was set aside"):
        ck.read_quarantine(spark, path)


def test_one_scan(spark, tmp_path):
    """Judging is a projection over one scan, and the source is read once in all."""
    src, path = str(tmp_path / "src"), str(tmp_path / "t")
    writers.write_table(spark.range(1000).select("id", F.lit("x").alias("name"), F.lit(1).alias("size")), src)
    plan = ck.judged(spark.read.parquet(src), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(src)
    df = df.mapInArrow(counted, df.schema)
    ck.commit_checked(df, path, RULES[:2], unique=["id"])
    assert reads.value == 1000


def test_zone_map_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "fact")
    many = spark.range(20_000).select((F.col("id") % 400).cast("string").alias("user_id"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_table(many, path, ranged_by=["user_id", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    everything = len(spark.read.parquet(path).inputFiles())
    zones.write_zones(spark, path, ["user_id"])
    got = readers.load_fact(spark, path, "7")
    assert everything >= 6 and len(got.inputFiles()) <= 2 and got.count() == 50
    assert readers.load_fact(spark, path, "nobody").count() == 0 and readers.load_fact(spark, path).count() == 20_000
    # Files that the map does not know: the reader does without it.
    many.filter("user_id = '7'").withColumn("id", F.lit(-1).cast("long")).write.mode("append").parquet(path)
    assert len(readers.load_fact(spark, path, "7").inputFiles()) > 2 and readers.load_fact(spark, path, "7").count() == 100
    assert zones.files_where(spark, path, "user_id", "7") is None


def test_fact_has_a_zone_map(spark, tmp_path):
    lake = Lake(str(tmp_path))
    start = F.lit("2024-03-01").cast("timestamp_ntz")
    fact = spark.range(3000).select((F.col("id") % 300).cast("string").alias("user_id"), (start + F.make_interval(hours=F.col("id"))).alias("start_time"))
    gold.write_fact_sets(fact, lake)
    path = lake.gold("fact_train")
    got = readers.load_fact(spark, path, "17")
    assert got.count() == 10 and set(got.columns) == {"user_id", "start_time", "start_month"}
    early = zones.files_where(spark, path, "start_time", dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2))
    assert early and all("start_month=2024-03-01" in f for f in early)


def test_distinct_counts_without_expand(spark):
    rows = [(1, "a", 0.0, b"x", ["a, b"]), (1, "b", -0.0, b"y", ["a", "b"]), (2, None, float("nan"), None, None), (None, "a", float("nan"), b"x", ["a", "b"])]
    df = spark.createDataFrame(rows, "i INT, s STRING, d DOUBLE, b BINARY, l ARRAY<STRING>")
    got = metrics.table_counts(df, ["i", "s", "d", "b", "l"])
    assert tuple(got.first()) == (4, 2, 2, 2, 2, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Scan") == 1
    assert tuple(metrics.table_counts(df.limit(0), ["i", "s"]).first()) == (0, 0, 0)
    assert tuple(metrics.table_counts(df).first()) == (4,)
    assert tuple(metrics.table_counts(spark.range(5).select(F.lit(None).cast("string").alias("n")), ["n"]).first()) == (5, 0)
