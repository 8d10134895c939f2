"""Casts, defaults and small numeric features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.columns import as_col
from trainlake.functions.dates import minutes_between, parse_timestamp

# Class limits and labels of the two body-mass scales.
BMI_BANDS = ((18.5, "baixo_peso"), (25.0, "normal"), (30.0, "sobrepeso"))
BMI_TOP_BAND = "obesidade"
FORM_BMI_BANDS = (
    (18.5, "Abaixo do peso"),
    (25.0, "Peso saudável"),
    (30.0, "Sobrepeso"),
    (35.0, "Obesidade grau I"),
    (40.0, "Obesidade grau II"),
)
FORM_BMI_TOP_BAND = "Obesidade grau III"
FORM_BMI_UNKNOWN = "—"
MIN_WEEKLY_MINUTES = 150
# Profile fields a plan needs, with the label shown for a missing one.
REQUIRED_PROFILE = {
    "peso": "Peso (kg)",
    "altura": "Altura (cm)",
    "gordura": "Gordura (%)",
    "objetivo": "Objetivo",
    "experiencia": "Nível de experiência",
    "dias_semana": "Dias de treino por semana",
    "minutos_por_treino": "Minutos por treino",
    "tipo_treino_principal": "Tipo de treino principal",
}


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns that exist; a value that does not fit becomes NULL.

    ``timestamp_ntz`` and ``date`` columns try every known spelling.
    """
    out = {}
    for name, target in types.items():
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`")
        if target in ("timestamp_ntz", "date") and isinstance(df.schema[name].dataType, T.StringType):
            out[name] = parse_timestamp(value).cast(target)
        else:
            out[name] = value.try_cast(target)
    return df.withColumns(out)


def meters_to_km(col: Column | str) -> Column:
    return as_col(col) / F.lit(1000.0)


def with_duration(
    df: DataFrame,
    start: str = "start_time",
    end: str = "end_time",
    seconds: str = "duration_seconds",
    name: str = "duracao",
) -> DataFrame:
    """Session minutes; sets without both times fall back to their own seconds."""
    if start not in df.columns or end not in df.columns:
        return df
    minutes = minutes_between(start, end)
    if seconds in df.columns:
        minutes = F.coalesce(minutes, F.col(seconds) / F.lit(60.0))
    return df.withColumn(name, minutes)


def with_id_string(df: DataFrame, source: str = "id", name: str = "id_exercice") -> DataFrame:
    return df.withColumn(name, F.col(source).cast("string")) if source in df.columns else df


def with_volume(df: DataFrame, weight: str = "weight_kg", reps: str = "reps") -> DataFrame:
    return df.withColumn("volume", F.col(weight) * F.col(reps))


def with_ingestion_ts(df: DataFrame, name: str = "ingestion_date", ts: Column | None = None) -> DataFrame:
    """Audit time; pass ``ts`` to replay a run with its own time."""
    return df.withColumn(name, F.current_timestamp() if ts is None else ts)


def non_empty(df: DataFrame, name: str) -> Column:
    """The column with empty text, zero and false turned into NULL."""
    value = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.nullif(value, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.nullif(value, F.lit(0).cast(kind))
    return value


def first_non_empty(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """Text of the first listed column that exists and is not NULL, '' or 0."""
    found = [non_empty(df, n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default).cast("string"))


def missing_fields(df: DataFrame, checks: Mapping[str, str] = REQUIRED_PROFILE) -> Column:
    """Labels of the fields that are absent, NULL, '' or 0, in the order of ``checks``."""
    marks = []
    for name, label in checks.items():
        if name in df.columns:
            marks.append(F.when(non_empty(df, name).isNull(), F.lit(label)))
        else:
            marks.append(F.lit(label))
    return F.array_compact(F.array(*marks))


def _band(value: Column, bands: Sequence[tuple[float, str]], top: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in bands:
        out = out.when(value < limit, F.lit(label))
    return out.otherwise(F.lit(top))


def with_bmi(df: DataFrame, weight: str = "peso", height: str = "altura") -> DataFrame:
    """Body-mass index from metres and its four classes; no height gives NULL."""
    if weight not in df.columns or height not in df.columns:
        return df
    h = F.col(height).cast("double")
    df = df.withColumn("imc", F.try_divide(F.col(weight).cast("double"), h * h))
    return df.withColumn("faixa_imc", _band(F.col("imc"), BMI_BANDS, BMI_TOP_BAND))


def form_bmi(weight: Column | str, height: Column | str) -> Column:
    """Body-mass index with one decimal; heights above 3 are centimetres."""
    w = F.nullif(as_col(weight).cast("double"), F.lit(0.0))
    h = as_col(height).cast("double")
    metres = F.when(h > 3, h / 100.0).when(h > 0, h)
    return F.round(w / (metres * metres), 1)


def with_bmi_form(df: DataFrame, weight: str = "peso", height: str = "altura") -> DataFrame:
    df = df.withColumn("bmi", form_bmi(weight, height))
    band = _band(F.col("bmi"), FORM_BMI_BANDS, FORM_BMI_TOP_BAND)
    return df.withColumn("bmi_class", F.coalesce(band, F.lit(FORM_BMI_UNKNOWN)))


def with_weekly_minutes(
    df: DataFrame, days: str = "dias_semana", minutes: str = "minutos_por_treino"
) -> DataFrame:
    """Planned minutes per week and whether they miss the recommended minimum."""
    total = F.nullif(F.col(days) * F.col(minutes), F.lit(0))
    df = df.withColumn("weekly_minutes", total)
    return df.withColumn("below_minimum", F.col("weekly_minutes") < MIN_WEEKLY_MINUTES)


def mean(col: Column | str) -> Column:
    """Mean as one division of the sum, so that exact sums give exact means."""
    c = as_col(col)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
