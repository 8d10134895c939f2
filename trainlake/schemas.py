"""Schemas and fixed column lists of the bronze, silver and gold tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Column names, types and orders of the published table formats.

WORKOUT_CSV = _schema(
    [
        ("user_id", INT),
        ("title", STRING),
        ("start_time", STRING),
        ("end_time", STRING),
        ("description", STRING),
        ("exercise_title", STRING),
        ("superset_id", INT),
        ("exercise_notes", STRING),
        ("set_index", INT),
        ("set_type", STRING),
        ("weight_kg", DOUBLE),
        ("reps", DOUBLE),
        ("distance_km", DOUBLE),
        ("duration_seconds", DOUBLE),
        ("rpe", DOUBLE),
    ]
)

RAW_SET = _schema(
    [
        ("index", INT),
        ("type", STRING),
        ("weight_kg", DOUBLE),
        ("reps", DOUBLE),
        ("distance_meters", DOUBLE),
        ("duration_seconds", DOUBLE),
        ("rpe", DOUBLE),
    ]
)
RAW_EXERCISE = _schema(
    [
        ("title", STRING),
        ("notes", STRING),
        ("superset_id", INT),
        ("sets", T.ArrayType(RAW_SET)),
    ]
)
RAW_WORKOUT = _schema(
    [
        ("id", STRING),
        ("title", STRING),
        ("description", STRING),
        ("routine_id", STRING),
        ("start_time", STRING),
        ("end_time", STRING),
        ("created_at", STRING),
        ("updated_at", STRING),
        ("exercises", T.ArrayType(RAW_EXERCISE)),
    ]
)

WORKOUT_PAGE = (
    T.StructType()
    .add("page", T.IntegerType())
    .add("page_count", T.IntegerType())
    .add("workouts", T.ArrayType(RAW_WORKOUT))
)

FACT_ORDER = [
    "user_id", "sk_exercise", "id_exercice", "id", "routine_id", "title", "description",
    "start_time", "end_time", "duracao", "exercise_title", "superset_id", "exercise_notes",
    "set_index", "set_type", "weight_kg", "reps", "distance_km", "duration_seconds", "rpe",
    "main_muscle", "target_muscles", "synergist_muscles", "equipment", "updated_at", "created_at",
    "exercise_name_kaggle", "exercises",
]

CATALOG_RENAMES = {
    "Exercise Name": "exercise_name_kaggle",
    "Main_muscle": "main_muscle",
    "Target_Muscles": "target_muscles",
    "Synergist_Muscles": "synergist_muscles",
    "Equipment": "equipment",
}
CATALOG_COLUMNS = ["exercise_name_kaggle", "main_muscle", "target_muscles", "synergist_muscles", "equipment"]

# Both lead to the names that the fact's mapping join asks for.
MAPPING_RENAMES = {
    "exercise_title_hevy": "exercise_title_heavy",
    "exercise_kaggle": "exercise_name_kaggle",
}

_ACCENTED = {
    "nível_treinamento": "nivel_treinamento",
    "restrições_físicas": "restricoes_fisicas",
    "frequência_semanal": "frequencia_semanal",
}
# The accented names also occur as UTF-8 text that was read as Latin-1.
PROFILE_RENAMES = {
    **_ACCENTED,
    **{name.encode("utf-8").decode("latin-1"): plain for name, plain in _ACCENTED.items()},
    "percentual_gordura(%)": "percentual_gordura",
}

PROFILE_FIELDS = [
    "nome", "data_nascimento", "sexo", "peso", "altura", "percentual_gordura", "objetivo",
    "nivel_treinamento", "restricoes_fisicas", "frequencia_semanal", "horas_sono", "nutricional_score",
]
PROFILE_NUMBERS = ["peso", "altura", "percentual_gordura", "frequencia_semanal", "horas_sono", "nutricional_score"]

ACCOUNTS = _schema(
    [
        ("user_id", STRING),
        ("nome", STRING),
        ("email", STRING),
        ("created_at", STRING),
        ("data_nascimento", STRING),
        ("sexo", STRING),
        ("peso", DOUBLE),
        ("altura", DOUBLE),
        ("percentual_gordura", DOUBLE),
        ("objetivo", STRING),
        ("nivel_treinamento", STRING),
        ("restricoes_fisicas", STRING),
        ("frequencia_semanal", DOUBLE),
        ("horas_sono", DOUBLE),
        ("nutricional_score", DOUBLE),
    ]
)

EXERCISES_DIM = _schema(
    [
        ("exercise_id", STRING),
        ("exercise_name", STRING),
        ("equipment", STRING),
        ("variation", STRING),
        ("utility", STRING),
        ("mechanics", STRING),
        ("force", STRING),
        ("main_muscle", STRING),
        ("difficulty_(1_5)", INT),
    ]
)
MUSCLES_BRIDGE = _schema(
    [
        ("exercise_id", STRING),
        ("muscle", STRING),
        ("muscle_type", STRING),
    ]
)
INSTRUCTIONS_BRIDGE = _schema(
    [
        ("exercise_id", STRING),
        ("step_number", INT),
        ("instruction", STRING),
    ]
)

DAILY_WORKOUTS = _schema(
    [
        ("user_id", STRING),
        ("workout_id", STRING),
        ("date", DATE),
        ("weekday", INT),
        ("muscle_group", STRING),
        ("duration_min", INT),
        ("total_sets", INT),
        ("total_reps", INT),
        ("avg_heart_rate", INT),
        ("perceived_exertion", INT),
    ]
)
