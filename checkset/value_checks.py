"""Dates, casts and profile features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query, rounded
from checkset.tables import Tables, with_views
from trainlake.functions import dates as dt
from trainlake.functions import values as vl

AS_OF = "2024-06-15 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    """SELECT event_id, ts, CAST(ts AS DATE) AS date_only,
      CAST(weekofyear(ts) AS INTEGER) AS week, CAST(year(ts) AS INTEGER) AS year,
      strftime(ts, '%Y-%U') AS year_week, CAST(date_trunc('month', ts) AS DATE) AS month,
      dayname(ts) AS dow, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events""",
    dates=["date_only", "month"],
)
def calendar(t: Tables) -> DataFrame:
    return dt.with_calendar(t.events.select("event_id", "ts"), "ts")


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%U') AS year_week,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders""",
    dates=["monday"],
)
def week_numbers(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        dt.sunday_week("o_orderdate").alias("year_week"),
        dt.monday_of("o_orderdate").alias("monday"),
    )


@query(
    f"""SELECT o_orderkey, floor(date_diff('microsecond', o_orderdate,
      TIMESTAMP '{AS_OF}') / 86400000000) / 365.25 AS idade_anos FROM orders"""
)
def age_years(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dt.age_years("o_orderdate", as_of()).alias("idade_anos"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(2024 - year(o_orderdate)
      - CASE WHEN 615 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END
      AS INTEGER) END AS idade FROM orders"""
)
def completed_age(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.lit("unknown"))
    )
    return t.orders.select("o_orderkey", dt.completed_age(text, as_of()).alias("idade"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END AS day
    FROM orders""",
    dates=["day"],
)
def parse_date(t: Tables) -> DataFrame:
    fmt = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = fmt.otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", dt.parse_date(text).alias("day"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
      ELSE date_trunc('second', ts) + INTERVAL 3 HOUR END AS utc FROM events"""
)
def utc_timestamps(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-03:00'")
    bad = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(text)
    return t.events.select("event_id", dt.to_utc(bad).alias("utc"))


@query("SELECT event_id, ts - INTERVAL 3 HOUR AS local_time FROM events")
def local_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", dt.to_local("ts").alias("local_time"))


@query(
    with_views(
        "sets",
        """SELECT id, set_index, weight_kg, CASE WHEN set_type = 'N'
          THEN CAST(reps AS DOUBLE) / 60
          ELSE date_diff('microsecond', start_time, end_time) / 60000000 END AS duracao
        FROM sets""",
    )
)
def duration_minutes(t: Tables) -> DataFrame:
    sets = t.sets().withColumns(
        {
            "end_time": F.when(F.col("set_type") != "N", F.col("end_time")),
            "duration_seconds": F.col("reps").cast("double"),
        }
    )
    return vl.with_duration(sets).select("id", "set_index", "weight_kg", "duracao")


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag = 'A'
      THEN l_quantity / 1000 END AS distance_km FROM lineitem"""
)
def distance_km(t: Tables) -> DataFrame:
    metres = F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", vl.meters_to_km(metres).alias("distance_km")
    )


@query(
    with_views(
        "sets",
        """SELECT id, CAST(id AS VARCHAR) AS id_exercice, set_index,
          CAST(weight_kg * reps AS DOUBLE) AS volume FROM sets""",
    )
)
def set_volume(t: Tables) -> DataFrame:
    return vl.with_volume(vl.with_id_string(t.sets())).select("id", "id_exercice", "set_index", "volume")


@query(
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
      CASE WHEN event_type <> 'error' THEN value END AS number,
      CASE WHEN event_type = 'click' THEN date_trunc('minute', ts)
           WHEN event_type = 'view' THEN ts
           WHEN event_type = 'signup' THEN date_trunc('day', ts) END AS moment,
      event_type IN ('click', 'view') AS flag
    FROM events"""
)
def coerce_types(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"),
        F.when(kind == "error", F.lit("abc")).otherwise(F.col("value").cast("string")).alias("number"),
        F.when(kind == "click", F.date_format("ts", "d MMM yyyy, HH:mm"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "signup", F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.lit("yesterday"))
        .alias("moment"),
        F.when(kind.isin("click", "view"), F.lit("true")).otherwise(F.lit("false")).alias("flag"),
    )
    types = {"k": "int", "number": "double", "moment": "timestamp_ntz", "flag": "boolean", "absent": "int"}
    return vl.coerce(raw, types)


@query(
    """SELECT p_partkey, (p_size - 1) / 25 AS altura, p_retailprice / 10 AS peso, imc,
      CASE WHEN imc IS NULL THEN NULL WHEN imc < 18.5 THEN 'baixo_peso' WHEN imc < 25 THEN 'normal'
           WHEN imc < 30 THEN 'sobrepeso' ELSE 'obesidade' END AS faixa_imc
    FROM (SELECT *, CASE WHEN p_size > 1 THEN p_retailprice / 10
      / ((p_size - 1) / 25 * ((p_size - 1) / 25)) END AS imc FROM part)"""
)
def bmi(t: Tables) -> DataFrame:
    people = t.part.select(
        "p_partkey",
        ((F.col("p_size") - 1) / F.lit(25.0)).alias("altura"),
        (F.col("p_retailprice") / 10).alias("peso"),
    )
    return vl.with_bmi(people)


# Centimetres and metres give the same index; no height gives none.
_FORM_METRES = "CASE WHEN p_type <> 'ECONOMY' THEN CAST(p_size + 140 AS DOUBLE) / 100 END"


@query(
    f"""WITH people AS (
      SELECT p_partkey, CAST(p_size + 40 AS DOUBLE) AS peso, {_FORM_METRES} AS m FROM part),
    indexed AS (SELECT p_partkey, {rounded('peso / (m * m)', 1)} AS bmi FROM people)
    SELECT p_partkey, bmi, CASE WHEN bmi IS NULL THEN '—' WHEN bmi < 18.5 THEN 'Abaixo do peso'
      WHEN bmi < 25 THEN 'Peso saudável' WHEN bmi < 30 THEN 'Sobrepeso'
      WHEN bmi < 35 THEN 'Obesidade grau I' WHEN bmi < 40 THEN 'Obesidade grau II'
      ELSE 'Obesidade grau III' END AS bmi_class FROM indexed"""
)
def bmi_form(t: Tables) -> DataFrame:
    size, kind = F.col("p_size").cast("double"), F.col("p_type")
    height = (
        F.when(kind == "ECONOMY", F.lit(0.0)).when(kind == "PROMO", size + 140).otherwise((size + 140) / 100)
    )
    people = t.part.select("p_partkey", (size + 40).alias("peso"), height.alias("altura"))
    return vl.with_bmi_form(people).select("p_partkey", "bmi", "bmi_class")


@query(
    """SELECT p_partkey, nullif((p_size % 8) * p_size, 0) AS weekly_minutes,
      nullif((p_size % 8) * p_size, 0) < 150 AS below_minimum FROM part"""
)
def weekly_minutes(t: Tables) -> DataFrame:
    plans = t.part.select(
        "p_partkey", (F.col("p_size") % 8).alias("dias_semana"), F.col("p_size").alias("minutos_por_treino")
    )
    return vl.with_weekly_minutes(plans).select("p_partkey", "weekly_minutes", "below_minimum")


@query(
    """SELECT c_custkey, concat_ws(', ', CASE WHEN c_nationkey = 0 THEN 'Peso (kg)' END, 'Altura (cm)',
      'Gordura (%)', CASE WHEN c_mktsegment = 'BUILDING' THEN 'Objetivo' END, 'Nível de experiência',
      'Dias de treino por semana', 'Minutos por treino',
      CASE WHEN c_acctbal < 0 THEN 'Tipo de treino principal' END) AS missing FROM customer"""
)
def missing_fields(t: Tables) -> DataFrame:
    profiles = t.customer.select(
        "c_custkey",
        F.col("c_nationkey").alias("peso"),
        F.lit(0.0).alias("altura"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("objetivo"),
        F.lit("").alias("experiencia"),
        F.when(F.col("c_acctbal") >= 0, F.lit("força")).alias("tipo_treino_principal"),
    )
    return profiles.select("c_custkey", F.array_join(vl.missing_fields(profiles), ", ").alias("missing"))


@query(
    """SELECT d.doc_id, coalesce(CAST(nullif(toxic, 0) AS VARCHAR), CAST(nullif(quality, 0) AS VARCHAR),
      CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'Não informado') AS shown,
      concat_ws(', ', CASE WHEN coalesce(quality, 0) = 0 THEN 'Quality' END,
        CASE WHEN coalesce(toxic, 0) = 0 THEN 'Toxic' END, 'Absent',
        CASE WHEN lang = 'en' THEN 'Language' END) AS missing
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def first_non_empty(t: Tables) -> DataFrame:
    lang = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    docs = t.documents.select("doc_id", lang.alias("lang")).join(t.labels, "doc_id", "left")
    checks = {"quality": "Quality", "toxic": "Toxic", "absent": "Absent", "lang": "Language"}
    return docs.select(
        "doc_id",
        vl.first_non_empty(docs, ["toxic", "absent", "quality", "lang"], "Não informado").alias("shown"),
        F.array_join(vl.missing_fields(docs, checks), ", ").alias("missing"),
    )


@query("SELECT c_custkey, c_name, TIMESTAMP '2024-06-15 12:00:00' AS ingestion_date FROM customer")
def ingestion_time(t: Tables) -> DataFrame:
    return vl.with_ingestion_ts(t.customer.select("c_custkey", "c_name"), ts=as_of())
