"""Text documents about a user's history and profile, one row per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.functions.columns import as_col
from trainlake.functions.dates import completed_age
from trainlake.functions.values import first_non_empty

# The lines of the history text.
HISTORY_TITLE = "Histórico real de treinos (GOLD fact_train):"
HISTORY_NUMBERS = (
    ("- Total de séries (soma): ", "total_sets"),
    ("- Total de repetições (soma): ", "total_reps"),
    ("- Carga média registrada: ", "avg_weight"),
    ("- Intensidade média (RPE/RIR/etc): ", "avg_rpe_or_intensity"),
)
TOP_EXERCISES = "- Exercícios mais frequentes: "
TOP_MUSCLES = "- Grupos musculares mais treinados: "
LAST_ROWS = "- Últimos registros (amostra):"

# The lines of the profile text; label, columns to try, text when empty.
# A line without columns is a heading.
PROFILE_LINES = (
    ("Perfil do aluno:", (), ""),
    ("- Nome: ", ("nome",), "Não informado"),
    ("- Idade: ", ("_age",), "Não informada"),
    ("- Data de nascimento: ", ("data_nascimento",), "Não informada"),
    ("- Sexo: ", ("sexo",), "Não informado"),
    ("\nComposição corporal:", (), ""),
    ("- Peso (kg): ", ("peso",), "Não informado"),
    ("- Altura: ", ("altura",), "Não informada"),
    ("- % Gordura: ", ("gordura", "percentual_gordura"), "Não informada"),
    ("\nObjetivo e nível:", (), ""),
    ("- Objetivo: ", ("objetivo",), "Não informado"),
    ("- Nível de treinamento/experiência: ", ("experiencia", "nivel_treinamento"), "Não informado"),
    ("- Foco do programa: ", ("foco_treino",), "Não informado"),
    ("\nRotina:", (), ""),
    ("- Frequência semanal (dias/semana): ", ("dias_semana", "frequencia_semanal"), "Não informada"),
    ("- Minutos por treino: ", ("minutos_por_treino",), "Não informado"),
    ("- Passos/dia: ", ("passos_dia",), "Não informado"),
    ("- Sono (horas/noite): ", ("sono_horas", "horas_sono"), "Não informado"),
    ("- Estresse (1 a 5): ", ("estresse_nivel",), "Não informado"),
    ("\nPreferências:", (), ""),
    ("- Tipo de treino principal: ", ("tipo_treino_principal",), "Não informado"),
    ("- Acesso a equipamentos: ", ("acesso_equipamentos",), "Não informado"),
    ("\nLimitações e observações:", (), ""),
    ("- Dores/limitações articulares: ", ("dores_articulacoes", "restricoes_fisicas"), "Nenhuma informada"),
    ("- Restrições médicas: ", ("restricoes_medicas",), "Nenhuma informada"),
    ("- Observações gerais: ", ("observacoes_gerais",), "Nenhuma"),
)


def two_decimals(col: Column | str) -> Column:
    """Number with at most two decimals and at least one, never in exponent form."""
    return F.regexp_replace(as_col(col).cast("decimal(38,2)").cast("string"), "0$", "")


def _top_line(tops: DataFrame, title: str, name: str, user: str, n: int) -> DataFrame:
    """``title value (3x), value (2x)`` from the first ``n`` rows of ``top_categories``."""
    entry = F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))
    ranked = F.sort_array(F.collect_list(F.struct("position", entry.alias("text"))))
    joined = F.array_join(F.transform(ranked, lambda r: r["text"]), ", ")
    return (
        tops.filter(F.col("position") <= n)
        .groupBy(user)
        .agg(F.concat(F.lit(title), joined).alias(name))
    )


def _last_lines(last: DataFrame, roles: dict[str, str], name: str, user: str, n: int) -> DataFrame:
    """One line per row of the last ``n`` of ``last_rows``; empty values are left out."""

    def part(role: str, label: str) -> Column:
        if role not in roles or roles[role] not in last.columns:
            return F.lit(None).cast("string")
        value = F.nullif(F.col(f"`{roles[role]}`").cast("string"), F.lit(""))
        return F.concat(F.lit(label), value)

    line = F.concat(
        F.lit("  • "),
        F.concat_ws(
            " | ",
            part("date", ""),
            part("exercise", ""),
            part("sets", "sets="),
            part("reps", "reps="),
            part("weight", "carga="),
            part("muscle", "musculo="),
            part("rpe", "int="),
        ),
    )
    rows = F.sort_array(F.collect_list(F.struct("position", line.alias("text"))))
    kept = F.slice(rows, F.greatest(F.size(rows) - (n - 1), F.lit(1)), F.lit(n))
    text = F.concat_ws("\n", F.lit(LAST_ROWS), F.transform(kept, lambda r: r["text"]))
    return last.groupBy(user).agg(text.alias(name))


def summary_text(
    summary: DataFrame,
    top_exercises: DataFrame | None = None,
    top_muscles: DataFrame | None = None,
    last: DataFrame | None = None,
    roles: dict[str, str] | None = None,
    user: str = "user_id",
    n_top: int = 6,
    n_last: int = 5,
) -> DataFrame:
    """History text per user; a line without a value or without its column is left out.

    The inputs are the results of ``training_summary``, ``top_categories`` and
    ``last_rows``: at most ten rows per user are joined to a text. ``roles`` names the
    columns of ``last`` for date, exercise, sets, reps, weight, muscle and rpe.
    """
    parts = summary
    if top_exercises is not None:
        parts = parts.join(_top_line(top_exercises, TOP_EXERCISES, "_ex", user, n_top), user, "left")
    if top_muscles is not None:
        parts = parts.join(_top_line(top_muscles, TOP_MUSCLES, "_mu", user, n_top), user, "left")
    if last is not None:
        parts = parts.join(_last_lines(last, roles or {}, "_last", user, n_last), user, "left")
    period = F.concat(
        F.lit("- Período: "),
        F.date_format("first_date", "yyyy-MM-dd"),
        F.lit(" até "),
        F.date_format("last_date", "yyyy-MM-dd"),
    )
    days = F.concat(
        F.lit("- Dias com treino: "),
        F.col("unique_days").cast("string"),
        F.lit(" | Semanas com registro: "),
        F.col("weeks").cast("string"),
    )
    dated = "first_date" in summary.columns
    lines = [F.lit(HISTORY_TITLE), *([period, days] if dated else [])]
    lines += [F.concat(F.lit(label), two_decimals(name)) for label, name in HISTORY_NUMBERS]
    lines += [F.col(c) for c in ("_ex", "_mu", "_last") if c in parts.columns]
    return parts.select(user, F.concat_ws("\n", *lines).alias("summary"))


def profile_text(
    users: DataFrame,
    summary: DataFrame | None,
    as_of: Column,
    user: str = "user_id",
    opening: str | None = None,
    closing: str | None = None,
) -> DataFrame:
    """Profile text per user with the history text behind it.

    Empty values show the default of their line. Instructions for the reader of the text
    are the caller's: ``opening`` and ``closing`` go around it.
    """
    named = users
    if "data_nascimento" in users.columns:
        named = named.withColumn("_age", completed_age("data_nascimento", as_of).cast("string"))
    lines = []
    for label, names, default in PROFILE_LINES:
        if names:
            lines.append(F.concat(F.lit(label), first_non_empty(named, names, default)))
        else:
            lines.append(F.lit(label))
    text = named.select(user, F.concat_ws("\n", *lines).alias("_profile"))
    parts = [F.lit(opening).cast("string"), F.col("_profile")]
    if summary is not None:
        text = text.join(summary.select(user, "summary"), user, "left")
        parts.append(F.col("summary"))
    parts.append(F.lit(closing).cast("string"))
    return text.select(user, F.concat_ws("\n\n", *parts).alias("context"))
