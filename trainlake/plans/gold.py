"""Gold tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.functions.dates import month_of
from trainlake.operators.joins import build_dim_exercise, enrich_muscles, join_mapping
from trainlake.operators.keys import distinct_rows, surrogate_key
from trainlake.operators.metrics import top_exercises
from trainlake.operators.quality import require_contract, require_unique
from trainlake.operators.shape import keep_existing, order_columns, rename, require_columns
from trainlake.plans.lake import Lake
from trainlake.plans.silver import read_silver_workouts
from trainlake.schemas import CATALOG_RENAMES, FACT_ORDER
from trainlake.sources.readers import read_latest_snapshot, read_table
from trainlake.sources.writers import write_metrics, write_snapshot, write_table
from trainlake.sources.zones import write_zones

# Columns and types that every fact has, whatever else its sources bring.
FACT_KEYS = "user_id STRING, sk_exercise BIGINT, start_time TIMESTAMP_NTZ, exercise_title STRING, exercise_name_kaggle STRING, main_muscle STRING"
DIM_COLUMNS = [*CATALOG_RENAMES.values(), "Preparation", "Execution"]
# Names of the gold metrics.
VOLUME_PER_DAY = "volume_por_dia"
ROWS_PER_DAY = "workouts_por_dia"
TOP_EXERCISES = "exercicios_mais_frequentes"


def build_fact_sets(
    sets: DataFrame, mapping: DataFrame, catalog: DataFrame, null_keys_match: bool = True
) -> DataFrame:
    """Every set with its mapped exercise, muscles and equipment, in the published order."""
    require_columns(catalog, ["Exercise Name"])
    fact = join_mapping(sets, mapping, null_keys_match)
    fact = enrich_muscles(fact, rename(catalog, CATALOG_RENAMES), null_keys_match)
    casts = {"user_id": "string", "id_exercice": "string", "sk_exercise": "long"}
    fact = fact.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in fact.columns})
    return order_columns(fact, FACT_ORDER)


def write_fact_sets(fact: DataFrame, lake: Lake) -> None:
    """Write the fact by start month and ranges of users, so that a user's rows of a month lie
    in one file or in neighbouring ones."""
    fact = fact.withColumn("start_month", month_of("start_time"))
    write_table(fact, lake.gold("fact_train"), ["start_month"], ranged_by=["start_month", "user_id", "start_time"])
    write_zones(fact.sparkSession, lake.gold("fact_train"), ["user_id", "start_time"])


def run_fact_sets(spark: SparkSession, lake: Lake) -> None:
    fact = build_fact_sets(
        read_silver_workouts(spark, lake).drop("start_month"),
        read_table(spark, lake.silver("mapping")),
        read_latest_snapshot(spark, lake.silver("catalog")).drop("snapshot_date"),
    )
    require_contract(fact, FACT_KEYS, "fact_train")
    write_fact_sets(fact, lake)


def run_dim_exercise(spark: SparkSession, lake: Lake) -> None:
    dim = build_dim_exercise(
        read_table(spark, lake.silver("mapping")),
        read_latest_snapshot(spark, lake.silver("catalog")).drop("snapshot_date"),
    )
    write_table(dim, lake.gold("dim_exercise"))


def build_dim_catalog(catalog: DataFrame) -> DataFrame:
    """Distinct exercises with a dense key, in the order of their columns."""
    require_columns(catalog, ["Exercise Name"])
    dim = distinct_rows(keep_existing(rename(catalog, CATALOG_RENAMES), DIM_COLUMNS))
    return surrogate_key(dim, "sk_exercise_kaggle", order=dim.columns)


def run_dim_catalog(spark: SparkSession, lake: Lake) -> None:
    catalog = read_latest_snapshot(spark, lake.silver("catalog")).drop("snapshot_date")
    dim = build_dim_catalog(catalog)
    require_unique(dim, "sk_exercise_kaggle", "dim_catalog")
    write_table(dim, lake.gold("dim_catalog"))


def promote_gold(
    lake: Lake,
    day: date,
    users: DataFrame,
    workouts: DataFrame,
    exercises: DataFrame | None = None,
) -> list[str]:
    """Dated gold copies; exercises only when the table has a ``title``."""
    paths = [write_snapshot(users, lake.gold("dim_users"), day)]
    if exercises is not None and "title" in exercises.columns:
        paths.append(write_snapshot(exercises, lake.gold("dim_exercises"), day))
    require_columns(workouts, ["start_time"])
    paths.append(write_snapshot(workouts, lake.gold("fact_workouts"), day))
    return paths


def metrics_rollup(
    sets: DataFrame,
    ts: str = "start_time",
    weight: str = "weight_kg",
    reps: str = "reps",
    exercise: str | None = "exercise_title",
) -> DataFrame:
    """Rows and volume per day, and per exercise where the table names one."""
    require_columns(sets, [ts])
    keys = [F.col(ts).cast("date").alias("day")]
    if exercise is not None and exercise in sets.columns:
        keys.append(F.col(exercise).alias("exercise"))
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight in sets.columns and reps in sets.columns:
        aggs.append(F.sum(F.col(weight) * F.col(reps)).alias("volume"))
    return sets.groupBy(*keys).agg(*aggs)


def _metric_rows(rollup: DataFrame, top: DataFrame | None) -> DataFrame:
    """Rows ``(metric, key, value)``; a metric whose columns are absent has none."""
    names = {ROWS_PER_DAY: F.sum("n")}
    if "volume" in rollup.columns:
        names[VOLUME_PER_DAY] = F.coalesce(F.sum("volume"), F.lit(0))
    days = rollup.filter(F.col("day").isNotNull()).groupBy("day")
    daily = days.agg(*[value.cast("double").alias(name) for name, value in names.items()])
    daily = daily.withColumn("key", F.col("day").cast("string"))
    rows = daily.unpivot("key", list(names), "metric", "value").select("metric", "key", "value")
    if top is None:
        return rows
    name, count = top.columns
    return rows.unionAll(top.select(F.lit(TOP_EXERCISES), F.col(name), F.col(count).cast("double")))


def metrics_from_rollup(rollup: DataFrame, n: int = 50) -> DataFrame:
    """Gold metrics from a written ``metrics_rollup``."""
    named = "exercise" in rollup.columns
    return _metric_rows(rollup, top_exercises(rollup, "exercise", n, rows="n") if named else None)


def build_metrics(
    sets: DataFrame,
    ts: str = "start_time",
    weight: str = "weight_kg",
    reps: str = "reps",
    exercise: str = "exercise_title",
    n: int = 50,
) -> DataFrame:
    """Gold metrics of the sets, the daily ones and the top list by one group-by each."""
    daily = metrics_rollup(sets, ts, weight, reps, exercise=None)
    return _metric_rows(daily, top_exercises(sets, exercise, n) if exercise in sets.columns else None)


def run_metrics(spark: SparkSession, lake: Lake, day: date) -> None:
    """Write the rollup first: the daily metrics and the top list then share its pass."""
    sets = read_latest_snapshot(spark, lake.gold("fact_workouts"))
    rollup = f"{lake.gold('metrics_rollup')}/snapshot_date={day.strftime('%Y%m%d')}"
    write_table(metrics_rollup(sets), rollup)
    metrics = metrics_from_rollup(read_table(spark, rollup))
    write_metrics(metrics, f"{lake.gold('metrics')}/snapshot_date={day.strftime('%Y%m%d')}")


def run_promote(spark: SparkSession, lake: Lake, day: date) -> list[str]:
    users = read_latest_snapshot(spark, lake.silver("users")).drop("snapshot_date")
    catalog = read_latest_snapshot(spark, lake.silver("catalog")).drop("snapshot_date")
    workouts = read_silver_workouts(spark, lake).drop("start_month")
    return promote_gold(lake, day, users, workouts, catalog)
