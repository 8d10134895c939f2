"""Table operators on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trainlake.operators import context, joins, keys, metrics, quality, shape
from trainlake.operators.nested import explode_workouts
from trainlake.schemas import RAW_WORKOUT


def rows(df):
    return [tuple(r) for r in df.collect()]


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


# --- shape ------------------------------------------------------------------------------


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["Exercise-Título á", " B "])
    assert shape.normalize_columns(df).columns == ["exercise_título_á", "b"]
    assert shape.normalize_columns(df, hyphen=False, fold=True).columns == ["exercise-título_a", "b"]
    with pytest.raises(ValueError):
        shape.normalize_columns(spark.createDataFrame([(1, 2)], ["A b", "a-b"]))


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["sk_exercise", "exercise_title", "date"])
    assert shape.resolve_column(df, ["timestamp", "date"]) == "date"
    assert shape.resolve_column(df, ["exercise_name", "exercise"]) == "sk_exercise"
    assert shape.resolve_column(df, ["exercise"], contains=False) is None


def test_require_and_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["c", "a", "b"])
    assert shape.order_columns(df, ["a", "x", "b"]).columns == ["a", "b", "c"]
    assert shape.keep_existing(df, ["b", "x"]).columns == ["b"]
    with pytest.raises(ValueError):
        shape.require_columns(df, ["a", "z"])


def test_filter_min_counts_null_as_zero(spark):
    df = spark.createDataFrame([(4.9,), (5.0,), (None,)], "score DOUBLE")
    assert rows(shape.filter_min(df, "score", 5)) == [(5.0,)]
    assert len(rows(shape.filter_min(df, "score", -1))) == 3


def test_filter_since(spark):
    df = spark.createDataFrame(
        [
            (1, "2025-01-01T00:00:00Z", None),
            (2, "2025-01-02T00:00:00Z", None),
            (3, "2025-01-02T00:00:01Z", None),
            (4, "bad", None),
            (5, "", "2025-01-01T00:00:00Z"),
            (6, None, None),
        ],
        "id INT, updated_at STRING, created_at STRING",
    )
    since = F.lit("2025-01-02 00:00:00").cast("timestamp")
    assert [r.id for r in shape.filter_since(df, since).collect()] == [3, 4, 5, 6]
    assert [r.id for r in shape.filter_since(df, since, fallback="created_at").collect()] == [3, 4, 6]
    assert shape.filter_since(df, None).count() == 6


def test_for_user(spark):
    df = spark.createDataFrame([(1,), (12,)], "user_id INT")
    assert rows(shape.for_user(df, "12")) == [(12,)]
    assert rows(shape.for_user(df, "012")) == []
    assert rows(shape.for_user(df, "abc")) == []
    texts = spark.createDataFrame([("a",), (None,)], "user_id STRING")
    assert rows(shape.for_user(texts, "a")) == [("a",)]


def test_user_id_for(spark):
    accounts = spark.createDataFrame([("u1", "Ana@x.com")], "user_id STRING, email STRING")
    assert rows(shape.user_id_for(accounts, " ana@X.com", "none")) == [("u1",)]
    assert rows(shape.user_id_for(accounts, "b@x.com", "none")) == [("none",)]


def test_union_aligned(spark):
    a = spark.createDataFrame([(1, "x")], "id INT, s STRING")
    b = spark.createDataFrame([("2", 3.0), ("q", 4.0)], "id STRING, d DOUBLE")
    out = shape.union_aligned(a, b)
    assert out.columns == ["id", "s", "d"]
    assert sorted(rows(out), key=str) == sorted([(1, "x", None), (2, None, 3.0), (None, None, 4.0)], key=str)


# --- keys -------------------------------------------------------------------------------


def test_latest_per_key_null_modes(spark):
    df = spark.createDataFrame([("a", ts(1), 1), ("a", ts(2), 2), ("a", None, 3)], "k STRING, t TIMESTAMP_NTZ, v INT")
    assert keys.latest_per_key(df, "k", "t").first().v == 2
    assert keys.latest_per_key(df, "k", "t", nulls="win").first().v == 3
    assert keys.latest_per_key(df, "k", "absent").first().v in (1, 2, 3)


def test_surrogate_key_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(7)
    got = sorted(rows(keys.surrogate_key(df, "sk", ["n"])))
    assert got == [(i + 1, i) for i in range(1000)]


def test_ensure_id_spreads_copies(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("n"))
    out = keys.ensure_id(df, "user_id", order=["n"])
    assert sorted(int(r.user_id) for r in out.collect()) == list(range(900))
    named = df.withColumnRenamed("n", "id")
    assert keys.ensure_id(named, "user_id", ["id"], alt="id").columns == ["user_id"]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = keys.first_per_key(df, ["k"], [F.desc("v")])._jdf.queryExecution().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


# --- nested -----------------------------------------------------------------------------


def test_explode_workouts(spark):
    sets = [(0, "normal", 10.0, 5.0, 500.0, None, 8.0), (1, "normal", None, None, None, 30.0, None)]
    good = ("w1", "T", None, None, "2024-01-01T10:00:00Z", "bad", None, "u", [("Squat", None, None, sets), ("Row", None, 1, None)])
    empty = ("w2", "T", None, None, None, None, None, "u", None)
    df = spark.createDataFrame([good, empty], RAW_WORKOUT)
    out = explode_workouts(df, "me", keep_nested=True).orderBy("set_index").collect()
    assert "exercises" not in explode_workouts(df, "me").columns
    assert [(r.user_id, r.id, r.exercise_title, r.set_index, r.distance_km) for r in out] == [
        ("me", "w1", "Squat", 0, 0.5),
        ("me", "w1", "Squat", 1, None),
    ]
    assert out[0].start_time == dt.datetime(2024, 1, 1, 10) and out[0].end_time is None
    assert len(out[0].exercises) == 2


def test_explode_count_is_the_sum_of_the_set_lists(spark):
    df = spark.range(50).select(
        F.col("id").cast("string").alias("id"),
        *[F.lit(None).cast("string").alias(c) for c in ("title", "description", "routine_id", "start_time", "end_time", "created_at", "updated_at", "user_id")],
        F.expr(
            """transform(filter(sequence(0, 3), i -> i < id % 4), i -> named_struct('title', 'x', 'notes', 'n',
            'superset_id', i, 'sets', transform(filter(sequence(0, 3), j -> j < (id + i) % 3), j -> named_struct(
            'index', j, 'type', 't', 'weight_kg', 1.0D, 'reps', 1.0D, 'distance_meters', 1.0D,
            'duration_seconds', 1.0D, 'rpe', 1.0D))))"""
        ).alias("exercises"),
    )
    sizes = df.select(F.expr("aggregate(exercises, 0, (n, e) -> n + size(e.sets))").alias("n"))
    assert explode_workouts(df).count() == sizes.agg(F.sum("n")).first()[0]


# --- joins ------------------------------------------------------------------------------


def test_join_mapping_null_keys(spark):
    fact = spark.createDataFrame([("a",), (None,), ("z",)], "exercise_title STRING")
    mapping = spark.createDataFrame(
        [("a", "A", 1), ("a", "B", 2), (None, "N", 3)],
        "exercise_title_heavy STRING, exercise_name_kaggle STRING, sk_exercise INT",
    )
    pandas_like = joins.join_mapping(fact, mapping)
    assert pandas_like.count() == 4 and pandas_like.filter("sk_exercise = 3").count() == 1
    sql_like = joins.join_mapping(fact, mapping, null_keys_match=False)
    assert sql_like.count() == 4 and sql_like.filter("sk_exercise = 3").count() == 0
    assert "exercise_title_heavy" not in pandas_like.columns


def test_enrich_never_fans_out(spark):
    fact = spark.createDataFrame([("a",), ("b",), (None,)], "exercise_name_kaggle STRING")
    catalog = spark.createDataFrame([("a", "m2"), ("a", "m1")], "exercise_name_kaggle STRING, main_muscle STRING")
    got = sorted(rows(joins.enrich_muscles(fact, catalog)), key=str)
    assert got == sorted([("a", "m1"), ("b", None), (None, None)], key=str)


def test_gold_view_fans_out(spark):
    e = spark.createDataFrame([("1", "Squat", "bar", "legs"), ("2", "Row", None, None)], "exercise_id STRING, exercise_name STRING, equipment STRING, main_muscle STRING")
    m = spark.createDataFrame([("1", "quads", "main"), ("1", "core", "secondary"), ("9", "x", "y")], "exercise_id STRING, muscle STRING, muscle_type STRING")
    i = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("1", 3, "c")], "exercise_id STRING, step_number INT, instruction STRING")
    out = joins.gold_view(e, m, i)
    assert out.filter("exercise_id = '1'").count() == 6
    assert rows(out.filter("exercise_id = '2'")) == [("2", "Row", None, None, None, None, None)]
    assert out.count() == 7


def test_dim_exercise_without_key(spark):
    mapping = spark.createDataFrame([("t1", "A"), ("t2", "B")], "exercise_title_heavy STRING, exercise_name_kaggle STRING")
    catalog = spark.createDataFrame([("A", "m", "e"), ("A", "m", "f"), ("A", "m", "e")], ["Exercise Name", "Main_muscle", "Equipment"])
    out = joins.build_dim_exercise(mapping, catalog)
    assert sorted(r.sk_exercise for r in out.collect()) == [1, 2, 3]


def test_key_overlap_and_orphans(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k INT")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k INT")
    assert rows(joins.key_overlap(a, b, "k")) == [(2, 2, 1, 1)]
    assert sorted(rows(joins.orphans(b, a, "k")), key=str) == [(3,), (None,)]


def test_upsert_presence(spark):
    users = spark.createDataFrame([("u", "Ana", 60.0), ("v", "Bia", 70.0)], "user_id STRING, nome STRING, peso DOUBLE")
    changes = spark.createDataFrame(
        [("u", ts(1), "Anna", 61.0, ["nome", "peso"]), ("u", ts(2), None, None, ["peso"]), ("x", ts(3), "Xu", 1.0, ["nome"])],
        "user_id STRING, updated_at TIMESTAMP_NTZ, nome STRING, peso DOUBLE, changed ARRAY<STRING>",
    )
    by_field = sorted(rows(joins.upsert_profiles(users, changes, changed_fields="changed")))
    assert by_field == [("u", "Anna", None), ("v", "Bia", 70.0)]
    by_column = sorted(rows(joins.upsert_profiles(users, changes.drop("nome", "changed"))), key=str)
    assert by_column == [("u", "Ana", None), ("v", "Bia", 70.0)]


def test_insert_new_accounts(spark):
    users = spark.createDataFrame([("u1", "Ana", "Ana@x.com", None)], "user_id STRING, nome STRING, email STRING, sexo STRING")
    new = spark.createDataFrame([("Ana 2", "ANA@X.com "), ("Bia", "bia@x.com"), ("Bob", " Bia@x.com"), ("", "c@x.com"), ("Dan", None)], "nome STRING, email STRING")
    out = joins.insert_new_accounts(users, new).orderBy("email").collect()
    assert [(r.nome, r.email) for r in out] == [("Ana", "Ana@x.com"), ("Bia", "bia@x.com")]
    again = joins.insert_new_accounts(users, new).filter("nome = 'Bia'").first()
    assert again.user_id == out[1].user_id and len(again.user_id) == 36


def test_overlay(spark):
    base = spark.createDataFrame([("u", "a@x", "old"), ("v", "b@x", "old")], "user_id STRING, email STRING, objetivo STRING")
    over = spark.createDataFrame([("u", "", None, 5)], "user_id STRING, email STRING, objetivo STRING, dias INT")
    assert sorted(rows(joins.overlay(base, over))) == [("u", "a@x", None, 5), ("v", "b@x", "old", None)]


def test_latest_profiles_picks_the_dated_row(spark):
    df = spark.createDataFrame([("u", None, 1), ("u", ts(1), 2), ("u", ts(2), 3)], "user_id STRING, data_registro TIMESTAMP_NTZ, v INT")
    assert [r.v for r in joins.latest_profiles(df).collect()] == [3]


# --- metrics ----------------------------------------------------------------------------


def daily(spark, data):
    return spark.createDataFrame(data, "user_id STRING, date TIMESTAMP_NTZ, muscle_group STRING, exercise_name STRING, total_sets INT, total_reps INT, duration_min INT")


def test_sums_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(ts(1), None, 5.0), (None, 1.0, 1.0)], "start_time TIMESTAMP_NTZ, weight_kg DOUBLE, reps DOUBLE")
    assert rows(metrics.volume_per_day(df)) == [(dt.date(2024, 1, 1), 0.0)]
    assert rows(metrics.rows_per_day(df)) == [(dt.date(2024, 1, 1), 1)]


def test_user_kpis(spark):
    df = daily(spark, [("u", ts(1, 8), "a", "x", 3, 30, 40), ("u", ts(1, 20), "b", "x", 4, None, 45), ("u", ts(3), None, "y", 6, 10, None), ("u", None, "a", "x", 99, 9, 9)])
    row = metrics.user_kpis(df).first()
    assert (row.workouts, row.days, row.last_date) == (3, 2, dt.date(2024, 1, 3))
    assert (row.avg_total_sets, row.avg_total_reps, row.avg_duration_min) == (4.3, 20.0, 42.5)


def test_rolling_mean_counts_rows_not_days(spark):
    days = [("u", dt.date(2024, 1, 1) + dt.timedelta(days=3 * i), i) for i in range(9)]
    df = spark.createDataFrame(days, "user_id STRING, day DATE, daily_sets INT")
    got = [r.rolling_7d for r in metrics.rolling_mean(df).orderBy("day").collect()]
    assert got == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]


def test_share_and_ranking(spark):
    df = daily(spark, [("u", ts(1), "a", "x", 3, 1, 1), ("u", ts(2), "b", "y", 1, 1, 1), ("u", ts(2), None, "z", 1, 1, 1), ("v", ts(1), "a", "x", None, 1, 1)])
    got = {(r.user_id, r.muscle_group): r.percent for r in metrics.muscle_share(df).collect()}
    assert got == {("u", "a"): 75.0, ("u", "b"): 25.0, ("v", "a"): None}
    ranks = metrics.exercise_ranking(df, n=2).filter("user_id = 'u'").orderBy("position").collect()
    assert [(r.exercise_name, r.position) for r in ranks] == [("x", 1), ("y", 2)]


def test_dow_matrix_starts_on_monday(spark):
    df = daily(spark, [("u", ts(1), "a", "x", 3, 1, 1), ("u", ts(7), "a", "x", 2, 1, 1)])
    got = [(r.dow_index, r.dow) for r in metrics.dow_muscle_matrix(df).orderBy("dow_index").collect()]
    assert got == [(0, "Monday"), (6, "Sunday")]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ([0.0, 100.0], [(0.0, 5.0, 1), (95.0, 100.0, 1)]),
        ([1.0, 50.0], [(0.0, 5.0, 1), (45.0, 50.0, 1)]),
        ([7.0, 7.0], [(7.0, 7.5, 2)]),
        ([0.0], [(0.0, 0.05, 1)]),
        ([0.0, 10.0], [(0.0, 0.5, 1), (9.5, 10.0, 1)]),
    ],
)
def test_histogram_steps(spark, data, want):
    df = spark.createDataFrame([("u", v) for v in data], "user_id STRING, avg_rpe DOUBLE")
    got = sorted(rows(metrics.intensity_histogram(df).select("bin_start", "bin_end", "n")))
    assert got == [pytest.approx(w) for w in want]


def test_weeks_of_two_years(spark):
    data = [("u", dt.datetime(2023, 1, 3), None, "x", 1, 1, 1), ("u", dt.datetime(2024, 1, 2), None, "x", 2, 1, 1), ("u", dt.datetime(2024, 1, 3), None, "x", None, 1, 1)]
    row = metrics.training_summary(daily(spark, data)).first()
    assert (row.weeks, row.unique_days, row.avg_sets_per_week_rows) == (1, 3, 1.5)
    assert row.total_sets == 3.0 and row.avg_weight is None


def test_summary_reads_text_numbers(spark):
    df = spark.createDataFrame([("u", ts(1), "2.5"), ("u", ts(2), "x")], "user_id STRING, date TIMESTAMP_NTZ, weight_kg STRING")
    row = metrics.training_summary(df).first()
    assert (row.avg_weight, row.total_sets) == (2.5, None)


def test_top_categories_ties_go_by_name(spark):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", None)], "user_id STRING, c STRING")
    assert [(r.value, r.position) for r in metrics.top_categories(df, "c").orderBy("position").collect()] == [("a", 1), ("b", 2)]
    assert metrics.top_categories(df, "c", null_as_text=True).count() == 3


def test_last_rows(spark):
    df = spark.createDataFrame([("u", ts(d), d) for d in range(1, 15)] + [("u", None, 0)], "user_id STRING, date TIMESTAMP_NTZ, v INT")
    got = metrics.last_rows(df, n=3).orderBy("position").collect()
    assert [(r.position, r.date, r.v) for r in got] == [(1, "2024-01-12", 12), (2, "2024-01-13", 13), (3, "2024-01-14", 14)]


def test_high_water_mark_variants(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", None), ("", "2025-01-03T00:00:00Z"), ("bad", None)], "updated_at STRING, created_at STRING")
    text = F.col("last_sync").cast("string")
    assert rows(metrics.high_water_mark(df).select(text)) == [("2025-01-01 00:00:00",)]
    assert rows(metrics.high_water_mark(df, fallback="created_at").select(text)) == [("2025-01-03 00:00:00",)]
    now = F.lit("2026-01-01").cast("timestamp")
    assert rows(metrics.high_water_mark(df, missing=now).select(text)) == [("2026-01-01 00:00:00",)]


def test_progression(spark):
    df = spark.createDataFrame([("u", "x", ts(1), 10.0, 2.0), ("u", "x", ts(1), 12.0, 1.0), ("u", "x", ts(5), 11.0, 4.0)], "user_id STRING, exercise_title STRING, start_time TIMESTAMP_NTZ, weight_kg DOUBLE, reps DOUBLE")
    got = metrics.progression(df).orderBy("day").collect()
    assert [(r.max_weight, r.volume, r.weight_change, r.volume_change) for r in got] == [(12.0, 32.0, None, None), (11.0, 44.0, -1.0, 12.0)]


def test_vs_global_mean(spark):
    df = daily(spark, [("u", ts(1), "a", "x", 2, 1, 1), ("u", ts(2), "a", "x", 4, 1, 1), ("v", ts(1), "a", "x", 9, 1, 1)])
    got = {r.user_id: (r.user_mean, r.global_mean, r.difference) for r in metrics.vs_global_mean(df).collect()}
    assert got == {"u": (3.0, 5.0, -2.0), "v": (9.0, 5.0, 4.0)}


# --- context ----------------------------------------------------------------------------


def test_two_decimals(spark):
    df = spark.createDataFrame([(12.0,), (12.5,), (12.25,), (123456789.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(context.two_decimals("v")).collect()] == ["12.0", "12.5", "12.25", "123456789.0", None]


def test_profile_text_defaults(spark):
    users = spark.createDataFrame([("u", "", 0.0, None, 15.5)], "user_id STRING, nome STRING, peso DOUBLE, gordura DOUBLE, percentual_gordura DOUBLE")
    text = context.profile_text(users, None, F.lit("2024-01-01").cast("timestamp_ntz")).first().context
    lines = text.split("\n")
    assert lines[:3] == ["Perfil do aluno:", "- Nome: Não informado", "- Idade: Não informada"]
    assert "- % Gordura: 15.5" in lines and "- Peso (kg): Não informado" in lines
    assert lines[-1] == "- Observações gerais: Nenhuma"


# --- quality ----------------------------------------------------------------------------


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id INT")
    assert rows(quality.check_unique(df, "id")) == [(1, 2)]
    assert quality.check_not_null(df, "id").count() == 1
    with pytest.raises(RuntimeError):
        quality.require_rows(df.filter("id > 5"))


def test_dictionary_and_contract(spark):
    df = spark.createDataFrame([(1, "a")], "n INT, s STRING")
    got = rows(quality.data_dictionary(df, {"n": "number"}))
    assert got == [("n", "number", "int", "Numérica"), ("s", "Descrição da coluna s", "string", "Categórica")]
    checked = {r.column_name: r.status for r in quality.check_schema(df, "n BIGINT, x STRING").collect()}
    assert checked == {"n": "type", "x": "missing", "s": "undeclared"}


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "n INT, s STRING")
    assert rows(quality.profile(df)) == [("n", "int", 2, 0, "1"), ("s", "string", 2, 1, "a")]
