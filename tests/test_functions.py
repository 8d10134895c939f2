"""Column functions on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trainlake.functions import dates, text, values


def one(df, col):
    return [r[0] for r in df.select(col.alias("x")).collect()]


def words(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "s STRING")


def stamp(s):
    return F.lit(s).cast("timestamp_ntz")


def test_strip_removes_every_blank(spark):
    df = words(spark, " 　a b\x1c\n", "\xa0", None)
    assert one(df, text.strip("s")) == ["a b", "", None]


def test_clean_value_zero_width(spark):
    df = words(spark, "a\\u200bb​c\r\nd ", None)
    assert one(df, text.clean_value("s")) == ["abc  d", None]
    assert one(df, text.clean_value("s", zero_width=False)) == ["ab​c  d", None]


def test_clean_text_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, " x ")], "n INT, s STRING")
    assert [r.s for r in text.clean_text(df).orderBy("n").collect()] == [None, "x"]
    assert [r.s for r in text.clean_text(df, null_as_text=True).orderBy("n").collect()] == ["None", "x"]


def test_normalize_and_slug(spark):
    df = words(spark, "  Bench\t\n PRESS ", None)
    assert one(df, text.normalize_text("s")) == ["bench press", None]
    assert one(words(spark, "Push-Up Wide"), text.slug("s")) == ["push_up_wide"]


def test_mask_and_tokens(spark):
    df = words(spark, "", None, "12345678", "123456789")
    assert one(df, text.mask("s")) == ["(vazia)", "(vazia)", "***", "1234...6789"]
    keys = words(spark, " ab-cd-ef-gh-ij-kl-mn ", "--", None)
    assert one(keys, text.user_token("s")) == ["abcdefghijkl", "anon", "anon"]
    assert one(words(spark, " Ana@X.com\n"), text.canonical_email("s")) == ["ana@x.com"]


def test_parse_list(spark):
    df = words(spark, "['a', ' b c ', '']", "[]", None)
    assert one(df, text.parse_list("s")) == [["a", "b c"], [], []]
    assert one(words(spark, None), text.parse_list("s", null_as_text=True)) == [["None"]]


def test_utc_and_local(spark):
    df = words(spark, "2025-11-18T22:04:26.389Z", "2025-11-18T22:04:26+02:00", "x", None)
    assert one(df, dates.to_utc("s")) == [
        dt.datetime(2025, 11, 18, 22, 4, 26, 389000),
        dt.datetime(2025, 11, 18, 20, 4, 26),
        None,
        None,
    ]
    day = spark.range(1).select(stamp("2025-01-01 02:00:00").alias("s"))
    assert one(day, dates.to_local("s")) == [dt.datetime(2024, 12, 31, 23, 0)]


def test_parse_timestamp_formats(spark):
    df = words(spark, "5 Jan 2024, 07:30", "05/02/2024", "2024-03-01", "soon")
    assert one(df, dates.parse_timestamp("s")) == [
        dt.datetime(2024, 1, 5, 7, 30),
        dt.datetime(2024, 2, 5),
        dt.datetime(2024, 3, 1),
        None,
    ]


@pytest.mark.parametrize("day", ["2023-01-01", "2024-01-06", "2024-01-07", "2024-12-31", "2026-01-03"])
def test_sunday_week_is_percent_u(spark, day):
    df = spark.range(1).select(F.lit(day).cast("date").alias("d"))
    assert one(df, dates.sunday_week("d")) == [dt.date.fromisoformat(day).strftime("%Y-%U")]


def test_calendar(spark):
    df = spark.range(1).select(stamp("2024-12-30 10:00:00").alias("date"))
    row = dates.with_calendar(df).first()
    assert (row.date_only, row.week, row.year, row.dow, row.weekday) == (dt.date(2024, 12, 30), 1, 2024, "Monday", 0)
    assert row.month == dt.date(2024, 12, 1)


def test_ages(spark):
    df = words(spark, "2000-06-15", "16/06/2000", "2000-6-1", "later", None)
    assert one(df, dates.completed_age("s", stamp("2024-06-15 08:00:00"))) == [24, 23, 24, None, None]
    born = spark.range(1).select(stamp("2024-06-01 12:00:00").alias("b"))
    assert one(born, dates.age_years("b", stamp("2024-06-03 11:00:00"))) == [1 / 365.25]
    assert one(born, dates.age_years("b", stamp("2024-06-01 11:00:00"))) == [-1 / 365.25]


def test_parse_date(spark):
    assert one(words(spark, "2024-02-30", "2024-02-29", ""), dates.parse_date("s")) == [None, dt.date(2024, 2, 29), None]


def test_coerce(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("x", "no")], "a STRING, d STRING")
    rows = values.coerce(df, {"a": "double", "d": "date", "absent": "int"}).collect()
    assert [tuple(r) for r in rows] == [(1.5, dt.date(2024, 1, 2)), (None, None)]


def test_duration_falls_back_to_seconds(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 8, 45, 30), 60.0), (None, None, 90.0), (None, None, None)],
        "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, duration_seconds DOUBLE",
    )
    assert [r.duracao for r in values.with_duration(df).collect()] == [45.5, 1.5, None]
    assert "duracao" not in values.with_duration(df.drop("end_time")).columns


def test_bmi(spark):
    df = spark.createDataFrame(
        [(80.0, 1.8), (50.0, 1.8), (80.0, 0.0), (None, 1.8), (95.0, 1.8), (120.0, 1.8)], "peso DOUBLE, altura DOUBLE"
    )
    assert [r.faixa_imc for r in values.with_bmi(df).collect()] == ["normal", "baixo_peso", None, None, "sobrepeso", "obesidade"]


def test_bmi_form(spark):
    rows = [(80.0, 180.0), (80.0, 1.8), (0.0, 1.8), (80.0, 0.0), (80.0, None), (80.0, -1.0), (150.0, 180.0)]
    df = spark.createDataFrame(rows, "peso DOUBLE, altura DOUBLE")
    got = [(r.bmi, r.bmi_class) for r in values.with_bmi_form(df).collect()]
    unknown = (None, "—")
    assert got == [(24.7, "Peso saudável"), (24.7, "Peso saudável"), *[unknown] * 4, (46.3, "Obesidade grau III")]


def test_weekly_minutes(spark):
    df = spark.createDataFrame([(3, 50), (3, 49), (0, 60), (None, 60)], "dias_semana INT, minutos_por_treino INT")
    got = [(r.weekly_minutes, r.below_minimum) for r in values.with_weekly_minutes(df).collect()]
    assert got == [(150, False), (147, True), (None, None), (None, None)]


def test_first_non_empty_and_missing(spark):
    df = spark.createDataFrame([("", 0, 7.5), (None, 3, None), ("a", 0, 0.0)], "s STRING, n INT, d DOUBLE")
    assert one(df, values.first_non_empty(df, ["s", "gone", "n", "d"], "none")) == ["7.5", "3", "a"]
    checks = {"s": "S", "gone": "G", "n": "N", "d": "D"}
    assert one(df, values.missing_fields(df, checks)) == [["S", "G", "N"], ["S", "G", "D"], ["G", "N", "D"]]
