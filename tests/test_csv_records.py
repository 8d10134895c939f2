"""CSV records across byte ranges against the text that was written."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trainlake.plans.csv_etl import csv_feed
from trainlake.schemas import WORKOUT_CSV
from trainlake.sources import commits, csv_records, readers

SCHEMA = "id INT, a STRING, b STRING"


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(rng):
    return "".join(rng.choice('ab, \n"\r;é日') for _ in range(rng.choice([0, 1, 5, 30, 300])))


def write(path, rows, eol, rng):
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if x else rng.choice(["", '""'])
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("id,a,b" + eol)
        for i, a, b in rows:
            f.write(f"{i},{quoted(a)},{quoted(b)}" + eol + (eol if rng.random() < 0.1 else ""))


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_records_of_many_ranges(spark, tmp_path, small_ranges, eol):
    rng = random.Random(1)
    want = []
    for name in ("x", "y"):
        rows = [(k, texts(rng), texts(rng)) for k in range(100)]
        write(tmp_path / f"{name}.csv", rows, eol, rng)
        want += [(i, a or None, b or None) for i, a, b in rows]
    got = readers.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.rdd.getNumPartitions() >= 1 and csv_records.quoted_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 100
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_text_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {k} of one text" for k in range(500))
    path = tmp_path / "a.csv"
    path.write_text(f'id,a,b\n1,x,y\n2,"{long}","{long}"\n3,"","z\n"\n')
    rows = readers.read_csv(spark, str(path), SCHEMA).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "x", "y"), (2, long, long), (3, None, "z\n")]


def test_join_by_shuffle(spark, tmp_path, small_ranges, monkeypatch):
    """More ranges than may go to all tasks."""
    monkeypatch.setattr(csv_records, "BROADCAST_RANGES", 0)
    rng = random.Random(2)
    rows = [(k, texts(rng), texts(rng)) for k in range(60)]
    write(tmp_path / "x.csv", rows, "\n", rng)
    got = readers.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA)
    assert sorted(map(tuple, got.collect())) == [(i, a or None, b or None) for i, a, b in rows]


def test_broken_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,a,b\n1,"one\ntwo",y\nx,p,q\n3,too few\n4,"",r\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(path), SCHEMA).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(path), SCHEMA).select("a").collect()
    good, bad = readers.split_broken(readers.read_csv(spark, str(path), SCHEMA, broken="aside"))
    assert sorted(map(tuple, good.collect())) == [(1, "one\ntwo", "y"), (4, None, "r")]
    assert sorted(r._broken_record for r in bad.collect()) == ["3,too few", "x,p,q"]


def test_empty_files(spark, tmp_path):
    for name, text in (("header", "id,a,b\n"), ("nothing", ""), ("blank", "\n\n"), ("no_end", "id,a,b\n1,x,y")):
        (tmp_path / f"{name}.csv").write_text(text)
        got = readers.read_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMA).collect()
        assert [tuple(r) for r in got] == ([(1, "x", "y")] if name == "no_end" else [])


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('i,l,d,day,at,yes,text,none\n1,1,1.5,2024-01-02,2024-01-02 03:04:05,true,"a\nb",\n-2,9999999999,2,2024-1-3,2024-01-02T03:04:05Z,false,7,\n')
    got = readers.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    first = got.orderBy("l").first()
    assert (first.i, first.l, first.d, first.day, first.yes, first.text, first.none) == (1, 1, 1.5, dt.date(2024, 1, 2), True, "a\nb", None)


def test_plan_moves_lines_once(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,a,b\n1,x,y\n")
    plan = readers.read_csv(spark, str(path), SCHEMA)._jdf.queryExecution().executedPlan().toString()
    wide = [p for p in plan.split("\n") if "Exchange hashpartitioning(file" in p and "home" in p]
    assert len(wide) == 1 and "BroadcastHashJoin" in plan and "Python" not in plan


def test_feed_loads_each_file_once(spark, tmp_path, monkeypatch):
    src, base = tmp_path / "in", str(tmp_path / "lake")
    src.mkdir()
    header = ",".join(WORKOUT_CSV.names)
    line = '{k},Push,,,"one\ntwo",Bench,,,0,normal,60,8,,,\n'
    (src / "a.csv").write_text(f"{header}\n{line.format(k=1)}")
    assert [c.rows for c in csv_feed(spark, str(src), base)] == [1]
    (src / "b.csv").write_text(f"{header}\n{line.format(k=2)}{line.format(k=3)}")

    def dies(*_, **__):
        raise OSError("lost")

    from trainlake.plans import csv_etl

    rename = csv_etl.rename
    monkeypatch.setattr(csv_etl, "rename", dies)
    with pytest.raises(OSError):
        csv_feed(spark, str(src), base)
    monkeypatch.setattr(csv_etl, "rename", rename)
    assert [c.rows for c in csv_feed(spark, str(src), base)] == [2]
    assert csv_feed(spark, str(src), base) == []
    got = commits.read_committed(spark, f"{base}/silver/workouts_feed")
    assert sorted(r.user_id for r in got.collect()) == [1, 2, 3]
    assert got.filter(F.col("description") == "one\ntwo").count() == 3 and "workout_title" in got.columns


@pytest.mark.parametrize("bits", [0, 2])
def test_records_of_many_parts(spark, tmp_path, small_ranges, monkeypatch, bits):
    """Parts of one or four lines, dealt to many tasks; a header of several lines after blank ones."""
    monkeypatch.setattr(csv_records, "PART_BITS", bits)
    monkeypatch.setattr(csv_records, "TASK_BYTES", 1000)
    rng = random.Random(3)
    rows = [(k, texts(rng), texts(rng)) for k in range(80)]
    write(tmp_path / "x.csv", rows, "\n", rng)
    body = (tmp_path / "x.csv").read_bytes().removeprefix(b"id,a,b\n")
    (tmp_path / "x.csv").write_bytes(b'\n\n\nid,"a\n\n\nof many lines",b\n' + body)
    lines = csv_records.with_parts(csv_records.quoted_lines(spark, str(tmp_path)))
    assert lines.groupBy("file", "block", "part").count().agg(F.max("count")).first()[0] <= 1 << bits
    got = readers.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, a or None, b or None) for i, a, b in rows], key=str)
