"""Sources, sinks, incremental loads and whole jobs in temporary folders."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trainlake import session
from trainlake.plans import context, csv_etl, dashboard, gold, silver
from trainlake.plans.lake import Lake
from trainlake.schemas import ACCOUNTS, DAILY_WORKOUTS, FACT_ORDER, RAW_WORKOUT, WORKOUT_CSV
from trainlake.sources import readers, state, writers
from trainlake.streaming.batch import ingest_incremental
from trainlake.streaming.stream import stream_workouts

DAY = dt.date(2024, 6, 15)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def workout(key, updated, user="u", n=2):
    sets = [(i, "normal", 10.0 * (i + 1), 5.0, None, None, None) for i in range(n)]
    return (key, "Leg day", None, None, "2024-01-01T10:00:00Z", "2024-01-01T11:00:00Z", updated, updated, [("Squat", None, None, sets)])


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


def test_snapshot_rerun_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_snapshot(spark.range(3), path, DAY)
    writers.write_snapshot(spark.range(5), path, DAY)
    writers.write_snapshot(spark.range(2), path, DAY - dt.timedelta(days=1))
    assert readers.read_latest_snapshot(spark, path).count() == 5
    with pytest.raises(Exception):
        readers.read_latest_snapshot(spark, str(tmp_path / "none"))


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for d in (1, 2, 3):
        writers.write_snapshot(spark.range(d), path, dt.date(2024, 1, d))
    latest = readers.read_latest_snapshot(spark, path)
    assert len(latest.inputFiles()) >= 1 and all("/snapshot_date=20240103/" in f for f in latest.inputFiles())
    assert rows(latest) == [(0, 20240103), (1, 20240103), (2, 20240103)]


def test_read_latest_by_change_time(spark, tmp_path):
    import os

    old, new = tmp_path / "x" / "z_old.csv", tmp_path / "x" / "a_new.csv"
    old.parent.mkdir()
    old.write_text("id\n1\n")
    new.write_text("id\n2\n")
    os.utime(old, (1_000_000, 1_000_000))
    assert rows(readers.read_latest(spark, str(tmp_path / "x"), "csv", "id INT")) == [(2,)]
    with pytest.raises(RuntimeError):
        readers.read_latest(spark, str(tmp_path / "x"), "parquet")


def test_missing_folder_is_an_empty_table(spark, tmp_path):
    empty = readers.read_folder(spark, str(tmp_path / "none"), ACCOUNTS)
    assert empty.columns == ACCOUNTS.names and empty.count() == 0


def test_watermark(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.read_watermark(spark, path) is None
    first = dt.datetime(2025, 12, 2, 22, 4, 30, 83000, dt.timezone.utc)
    state.write_watermark(spark, path, first)
    assert state.read_watermark(spark, path) == first
    state.write_watermark(spark, path, first - dt.timedelta(days=9))
    assert state.read_watermark(spark, path) == first - dt.timedelta(days=9)


def test_watermark_reads_the_published_format(spark, tmp_path):
    folder = tmp_path / "state"
    folder.mkdir()
    (folder / "last_sync.json").write_text(json.dumps({"last_sync": "2025-12-02T22:04:30.083000+00:00"}, indent=2))
    assert state.read_watermark(spark, str(folder)).microsecond == 83000
    (folder / "last_sync.json").write_text("{not json")
    assert state.read_watermark(spark, str(folder)) is None


def test_csv_with_line_ends_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('name,text\n"a","one\ntwo ""three"""\n')
    assert rows(readers.read_any(spark, str(path))) == [("a", 'one\ntwo "three"')]


def test_pages_and_documents(spark, tmp_path):
    path = tmp_path / "pages.json"
    path.write_text('{"page":1,"page_count":2,"workouts":[{"id":"a"},{"id":"b"}]}\n{"page":2,"page_count":2,"workouts":null}\n')
    assert [r.id for r in readers.read_workout_pages(spark, str(path)).collect()] == ["a", "b"]
    docs = spark.createDataFrame([(7, None), (8, "u")], "_id INT, user_id STRING")
    assert rows(readers.normalize_documents(docs)) == [("7",), ("u",)]
    assert rows(readers.normalize_documents(docs.drop("user_id"))) == [("7",), ("8",)]


def test_metric_documents(spark):
    df = spark.createDataFrame([("m", "b", 2.0), ("m", "a", 1.0)], "metric STRING, key STRING, value DOUBLE")
    assert json.loads(writers.metric_documents(df).first().document) == {"a": 1.0, "b": 2.0}


def test_ingest_twice_adds_nothing(spark, tmp_path):
    raw_state, dst = str(tmp_path / "s"), str(tmp_path / "b")
    feed = spark.createDataFrame([workout("a", "2025-01-01T00:00:00Z"), workout("b", "2025-01-02T00:00:00Z")], RAW_WORKOUT)
    feed = feed.withColumn("user_id", F.lit("ab-cd"))
    assert ingest_incremental(spark, feed, raw_state, dst, DAY) == dt.datetime(2025, 1, 2, tzinfo=dt.timezone.utc)
    assert ingest_incremental(spark, feed, raw_state, dst, DAY) is None
    got = readers.read_table(spark, dst)
    assert rows(got.select("id", "user_id", "dt")) == [("a", "ab-cd", 20240615), ("b", "ab-cd", 20240615)]


def test_stream_counts_each_file_once(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ckpt"))
    for key in ("a", "b"):
        df = spark.createDataFrame([workout(key, "2025-01-01T00:00:00Z")], RAW_WORKOUT)
        writers.append_rows(df.withColumn("user_id", F.lit("u")), src)
        stream_workouts(spark, src, dst, ckpt).awaitTermination()
        stream_workouts(spark, src, dst, ckpt).awaitTermination()
    got = readers.read_table(spark, dst)
    assert got.count() == 4 and {r.duracao for r in got.collect()} == {60.0}


def test_silver_to_gold(spark, lake):
    base = [(1, "Old", "5 Jan 2024, 07:30", "5 Jan 2024, 08:00", None, "Squat", None, None, 0, "normal", 50.0, 5.0, None, None, 7.0)]
    writers.write_table(spark.createDataFrame(base, WORKOUT_CSV), lake.bronze("workouts_base"))
    new = spark.createDataFrame([workout("w", "2025-01-01T00:00:00Z")], RAW_WORKOUT)
    writers.append_rows(new, f"{lake.bronze('workouts')}/user=me/dt=20240615")
    silver.run_silver_workouts(spark, lake, "me")
    sets = readers.read_table(spark, lake.silver("workouts"))
    assert rows(sets.select("user_id", "duracao", "id_exercice")) == [("1", 30.0, None), ("me", 60.0, "w"), ("me", 60.0, "w")]

    catalog = [("Squat", "Legs\n", "Quads\\u200b", None, "Bar"), ("Squat", "Legs", "Quads", None, "Bar"), ("Row", "Back", None, None, None)]
    cols = "`Exercise Name` STRING, Main_muscle STRING, Target_Muscles STRING, Synergist_Muscles STRING, Equipment STRING"
    writers.write_snapshot(spark.createDataFrame(catalog, cols), lake.bronze("catalog"), DAY)
    silver.run_silver_catalog(spark, lake, DAY)

    mapping = "SK Exercise,Exercise Title Hevy,Exercise Name Kaggle,Score\n1,Squat,Squat,5\n1,Squat,Squat,5\n2,Row,Row,4.9\n3,Row,Row,abc\n"
    import pathlib

    folder = pathlib.Path(lake.bronze("mapping"))
    folder.mkdir(parents=True)
    (folder / "mapping.csv").write_text(mapping)
    silver.run_silver_mapping(spark, lake)
    assert rows(readers.read_table(spark, lake.silver("mapping")).select("sk_exercise")) == [(1,)]

    gold.run_fact_sets(spark, lake)
    fact = readers.load_fact(spark, lake.gold("fact_train"), "me")
    assert rows(fact.select("sk_exercise", "main_muscle", "target_muscles")) == [(1, "Legs", "Quads")] * 2
    assert [c for c in fact.columns if c in FACT_ORDER] == [c for c in FACT_ORDER if c in fact.columns]

    gold.run_dim_exercise(spark, lake)
    gold.run_dim_catalog(spark, lake)
    dim = readers.read_table(spark, lake.gold("dim_catalog"))
    assert rows(dim.select("sk_exercise_kaggle", "exercise_name_kaggle")) == [(1, "Row"), (2, "Squat")]

    users = spark.createDataFrame([("u", "2000-01-02"), ("u", "2000-01-02"), ("v", "?")], "`User Id` STRING, `Data Nascimento` STRING")
    writers.write_table(users, lake.bronze("users_form"))
    silver.run_silver_users(spark, lake, DAY)
    assert len(gold.run_promote(spark, lake, DAY)) == 2
    gold.run_metrics(spark, lake, DAY)
    got = readers.read_metrics(spark, lake.gold("metrics")).select("metric", "key", "value")
    assert ("exercicios_mais_frequentes", "Squat", 3.0) in rows(got)
    assert ("volume_por_dia", "2024-01-01", 150.0) in rows(got)


def test_gym_without_title_gets_positions(spark):
    raw = spark.createDataFrame([("B",), ("A",), ("A",)], "`Exercise Name` STRING")
    out = silver.build_silver_gym(raw.withColumnRenamed("Exercise Name", "Exercise-Name"))
    assert rows(out.select("exercise_id", "exercise_name")) == [("0", "A"), ("1", "B")]


def test_profiles_without_user_id(spark):
    as_of = F.lit("2024-06-15").cast("timestamp_ntz")
    raw = spark.createDataFrame([("80", "1.80", "M "), ("x", "0", None)], "Peso STRING, Altura STRING, Sexo STRING")
    out = silver.build_silver_profiles(raw, as_of)
    assert rows(out.select("peso", "faixa_imc", "sexo")) == [(80.0, "normal", "m"), (None, None, None)]
    assert {r.user_id for r in out.collect()} == {"0", "1"}


def test_csv_job_replaces_its_day(spark, tmp_path):
    src = tmp_path / "in.csv"
    header = ",".join(WORKOUT_CSV.names)
    src.write_text(header + "\n1,Push,,,,Bench,,,0,normal,60,8,,,\n")
    for _ in range(2):
        paths = csv_etl.csv_etl(spark, str(src), str(tmp_path / "lake"), DAY)
    out = readers.read_table(spark, paths["silver"])
    assert "workout_title" in out.columns and "exercise_name" in out.columns
    assert out.count() == 1 and paths["raw"].endswith("year=2024/month=06/day=15")


def test_dashboard_from_rollup_equals_direct(spark, tmp_path):
    data = []
    for i in range(60):
        day = dt.date(2023, 12, 20) + dt.timedelta(days=i // 2)
        data.append((f"u{i % 3}", str(i), day, day.weekday(), [None, "legs", "back"][i % 3 if i % 7 else 0], 30 + i, i % 9, 10 * i, 100, i % 10))
    workouts = spark.createDataFrame(data, DAILY_WORKOUTS).withColumnRenamed("perceived_exertion", "avg_rpe")
    paths = dashboard.run_dashboard(spark, workouts, str(tmp_path / "dash"))
    direct = {
        "kpis": dashboard.m.user_kpis(workouts),
        "weekly": dashboard.m.weekly_frequency(workouts),
        "daily": dashboard.m.rolling_mean(dashboard.m.daily_sets(workouts)),
        "muscle_share": dashboard.m.muscle_share(workouts),
        "dow_muscle": dashboard.m.dow_muscle_matrix(workouts),
    }
    for name, want in direct.items():
        got = readers.read_table(spark, paths[name]).select(*want.columns)
        assert rows(got) == rows(want), name
    assert {"intensity", "detail", "duration_volume"} <= set(paths)
    assert "workout_id" not in readers.read_table(spark, paths["detail"]).columns


def test_context_omits_empty_lines(spark):
    workouts = spark.createDataFrame([("u", dt.datetime(2024, 1, 1), None, "Squat")], "user_id STRING, date TIMESTAMP_NTZ, total_sets INT, exercise_name STRING")
    text = context.build_summaries(workouts).first().summary
    assert text.split("\n") == [
        "Histórico real de treinos (GOLD fact_train):",
        "- Período: 2024-01-01 até 2024-01-01",
        "- Dias com treino: 1 | Semanas com registro: 1",
        "- Exercícios mais frequentes: Squat (1x)",
        "- Últimos registros (amostra):",
        "  • 2024-01-01 | Squat",
    ]


def test_session_reads_the_object_store_from_the_environment(spark):
    env = {"S3_ENDPOINT_URL": "http://store:9000", "MINIO_ACCESS_KEY": "k", "MINIO_SECRET_KEY": "s"}
    got = session.get_session("t", env)
    assert got.conf.get("spark.sql.session.timeZone") == "UTC"
    assert got.conf.get("spark.hadoop.fs.s3a.path.style.access") == "true"


def test_shared_dir_is_the_configured_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in session.shared_dir(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_no_python_workers_in_any_plan(spark):
    import os

    from checkset import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    writes = {"silver_workouts", "silver_workouts_job", "stream_sets", "fact_job", "ingest_batches", "dashboard_job"}
    writes |= {"kpis_incremental", "summary_incremental", "dashboard_incremental", "csv_feed_job", "bucketed_accounts", "silver_increment_twice", "ledger_ingest", "stream_then_fact", "compacted_table"}
    for name, run in QUERIES.items():
        if name in writes:
            continue
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def broken_feed(tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('user_id,title,start_time\n1,"two\nlines",x\n2,plain,y\n')
    return str(path), "user_id INT, title STRING, start_time STRING"


def test_cut_records_are_never_rows(spark, tmp_path):
    path, schema = broken_feed(tmp_path)
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, path, schema, multi_line=False).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, path, schema, multi_line=False).select("user_id").collect()
    good, broken = readers.split_broken(readers.read_csv(spark, path, schema, multi_line=False, broken="aside"))
    assert rows(good) == [(2, "plain", "y")]
    assert sorted(r._broken_record for r in broken.collect()) == ['1,"two', 'lines",x']
    assert rows(readers.read_csv(spark, path, schema)) == [(1, "two\nlines", "x"), (2, "plain", "y")]


def test_csv_job_passes_the_option_on(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text(",".join(WORKOUT_CSV.names) + '\n1,Push,,,"one\ntwo",Bench,,,0,normal,60,8,,,\n')
    with pytest.raises(Exception):
        csv_etl.csv_etl(spark, str(src), str(tmp_path / "lake"), DAY)
    paths = csv_etl.csv_etl(spark, str(src), str(tmp_path / "lake"), DAY, multi_line=True)
    assert readers.read_table(spark, paths["silver"]).first().description == "one\ntwo"


def test_user_rows_lie_in_few_files(spark, lake):
    """Many users and a hot one: a user's rows of a month are in one or two of its files."""
    start = F.lit("2024-03-01").cast("timestamp_ntz")
    many = spark.range(40_000).select((F.col("id") % 500).cast("string").alias("user_id"), F.col("id"))
    hot = spark.range(30_000).select(F.lit("hot").alias("user_id"), F.col("id"))
    fact = many.unionAll(hot).withColumn("start_time", start + F.make_interval(secs=F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gold.write_fact_sets(fact, lake)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    places = readers.read_table(spark, lake.gold("fact_train")).select("user_id", F.col("_metadata.file_path").alias("file"))
    files = {r.user_id: r.n for r in places.groupBy("user_id").agg(F.count_distinct("file").alias("n")).collect()}
    assert places.select("file").distinct().count() >= 6
    assert max(n for u, n in files.items() if u != "hot") <= 2 and files["hot"] >= 2


def test_stream_writes_few_files(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ckpt"))
    feed = [workout(str(k), "2025-01-01T00:00:00Z") for k in range(40)]
    df = spark.createDataFrame(feed, RAW_WORKOUT).withColumn("user_id", F.lit("u"))
    month = F.concat(F.lit("2024-"), F.lpad((F.col("id").cast("int") % 10 + 1).cast("string"), 2, "0"), F.lit("-03T10:00:00Z"))
    df.withColumn("start_time", month).repartition(8).write.parquet(src)
    stream_workouts(spark, src, dst, ckpt).awaitTermination()
    got = readers.read_table(spark, dst)
    assert got.count() == 80 and len(got.inputFiles()) <= 10


def test_new_batches_read_late_folders_only(spark, tmp_path):
    feed, state_path = str(tmp_path / "feed"), str(tmp_path / "s")
    for day, key in ((DAY, "a"), (DAY + dt.timedelta(days=1), "b")):
        df = spark.createDataFrame([workout(key, f"{day}T12:00:00Z")], RAW_WORKOUT).withColumn("user_id", F.lit("u"))
        writers.append_batch(df, feed, day)
    state.write_watermark(spark, state_path, dt.datetime(2024, 6, 16, tzinfo=dt.timezone.utc))
    raw = readers.read_table(spark, feed)
    assert ingest_incremental(spark, raw, state_path, str(tmp_path / "dst"), DAY) == dt.datetime(2024, 6, 16, 12, tzinfo=dt.timezone.utc)
    plan = raw.filter(F.col("dt").cast("int") >= 20240616)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert rows(readers.read_table(spark, str(tmp_path / "dst")).select("id")) == [("b",)]


def test_state_stays_small(spark, tmp_path):
    import os

    path = str(tmp_path / "state")
    for k in range(6):
        state.write_watermark(spark, path, dt.datetime(2025, 1, 1 + k, tzinfo=dt.timezone.utc))
    assert state.read_watermark(spark, path) == dt.datetime(2025, 1, 6, tzinfo=dt.timezone.utc)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 3


def test_contracts_stop_the_job(spark, lake):
    from trainlake.plans import star
    from trainlake.schemas import EXERCISES_DIM, INSTRUCTIONS_BRIDGE, MUSCLES_BRIDGE

    row = ("1", "Squat", None, None, None, None, None, "Legs", 3)
    for name, data, kind in (
        ("muscles_bridge", [("1", "Quads", "main")], MUSCLES_BRIDGE),
        ("instructions_bridge", [("1", 1, "Stand")], INSTRUCTIONS_BRIDGE),
    ):
        writers.write_table(spark.createDataFrame(data, kind), lake.gold(name))
    for bad, message in (([row, row], "not unique"), ([(None, *row[1:])], "without a value")):
        writers.write_table(spark.createDataFrame(bad, EXERCISES_DIM), lake.gold("exercises_dim"))
        with pytest.raises(ValueError, match=message):
            star.run_gold_view(spark, lake)
    writers.write_table(spark.createDataFrame([row], EXERCISES_DIM).drop("equipment"), lake.gold("exercises_dim"))
    with pytest.raises(ValueError, match="equipment"):
        star.run_gold_view(spark, lake)
    writers.write_table(spark.createDataFrame([row], EXERCISES_DIM), lake.gold("exercises_dim"))
    assert readers.read_table(spark, star.run_gold_view(spark, lake)).count() == 1


def test_new_accounts_job(spark, lake):
    from trainlake.plans import profiles

    writers.write_snapshot(spark.createDataFrame([("u", "A", "a@x")], "user_id STRING, nome STRING, email STRING"), lake.gold("users_app"), DAY)
    new = spark.createDataFrame([("B", " B@x"), ("A2", "A@X"), ("", "c@x")], "nome STRING, email STRING")
    profiles.run_new_accounts(spark, lake, new, DAY + dt.timedelta(days=1))
    assert rows(readers.read_latest_snapshot(spark, lake.gold("users_app")).select("nome", "email")) == [("A", "a@x"), ("B", "b@x")]


def test_one_folder_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """A batch of one day and one user comes from one task, and is sorted by several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = spark.range(0, 20_000, 1, 1).select("id", F.lit("u").alias("user_id"), F.create_map(F.lit("k"), "id").alias("m"))
        writers.append_batch(rows, str(tmp_path / "raw"), dt.date(2024, 6, 15))
    finally:
        spark.conf.set(key, before)
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.columns == ["id", "user_id", "m", "dt"]
    assert back.agg(F.count("id"), F.countDistinct("id")).first()[:] == (20_000, 20_000)
    assert back.select(F.input_file_name()).distinct().count() > 3


def test_zone_limits_without_a_sort(spark, tmp_path):
    """Text limits of files are found without sorting the rows by file."""
    from trainlake.sources import zones

    path = str(tmp_path / "fact")
    spark.createDataFrame([(u, k) for k, u in enumerate(["a", "b", None, "c"])], "user_id string, k int").repartition(2).write.parquet(path)
    plans = []
    ordered = type(spark.range(1)).orderBy

    def seen(df, *cols, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ordered(df, *cols, **kw)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1)), "orderBy", seen)
        zones.write_zones(spark, path, ["user_id"])
    assert len(plans) == 1 and "SortAggregate" not in plans[0]
    found = zones.read_zones(spark, path)
    assert found.columns == ["file", "rows", "min_user_id", "max_user_id", "nulls_user_id"]
    assert found.agg(F.sum("rows"), F.min("min_user_id"), F.max("max_user_id"), F.sum("nulls_user_id")).first()[:] == (4, "a", "c", 1)
