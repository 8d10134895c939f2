"""Silver tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.functions.dates import age_years, month_of, to_utc
from trainlake.functions.text import clean_categories, clean_text, parse_list, slug
from trainlake.functions.values import (
    coerce,
    with_bmi,
    with_duration,
    with_id_string,
    with_ingestion_ts,
)
from trainlake.operators.keys import distinct_rows, ensure_id, first_per_key, latest_per_key
from trainlake.operators.nested import explode_workouts
from trainlake.operators.shape import filter_min, normalize_columns, rename, union_aligned
from trainlake.plans.lake import Lake
from trainlake.schemas import MAPPING_RENAMES, PROFILE_NUMBERS, PROFILE_RENAMES
from trainlake.session import cut_lineage
from trainlake.sources.buckets import BUCKETS, merge_buckets, read_buckets, read_pointer, write_buckets
from trainlake.sources.commits import LOADED_BY, MAX_FILES, Commit, commit_rows, file_names, listed_files, new_files, pinned, read_commits, read_committed
from trainlake.sources.readers import read_csv, read_increments, read_latest, read_table
from trainlake.sources.writers import write_snapshot, write_table

LIST_COLUMNS = ("primary_muscles", "secondary_muscles", "instructions")
GYM_CATEGORIES = ["body_part", "equipment", "type", "difficulty", "mechanics"]
BASE_FILE = "base_full.parquet"
PROFILE_CATEGORIES = ["sexo", "objetivo", "nivel_treinamento"]


def build_silver_workouts(
    base: DataFrame,
    increments: DataFrame | None,
    user_id: str | None = None,
    newest_only: bool = False,
    keep_nested: bool = False,
) -> DataFrame:
    """Base sets and the exploded new workouts of all users as one table with duration and id.

    ``user_id`` overrides the user of the new workouts. ``newest_only`` keeps the latest version
    of a workout that was delivered again. ``keep_nested`` adds a copy of the whole workout to
    each of its sets.
    """
    sets = base
    if increments is not None:
        if newest_only:
            increments = latest_per_key(increments, "id", "updated_at")
        sets = union_aligned(_typed(base), explode_workouts(increments, user_id, keep_nested, extra=True))
    else:
        sets = _typed(base)
    return with_id_string(with_duration(sets))


def _typed(df: DataFrame) -> DataFrame:
    df = coerce(df, {"start_time": "timestamp_ntz", "end_time": "timestamp_ntz"})
    return df.withColumn("user_id", F.col("user_id").cast("string"))


def run_silver_workouts(
    spark: SparkSession,
    lake: Lake,
    user_id: str | None = None,
    keep_nested: bool = False,
    newest_only: bool = False,
    rebuild: bool = False,
    max_files: int | None = MAX_FILES,
) -> list[Commit]:
    """Silver sets of all users: the batches that the table has not consumed, each exactly once.

    The first run, and one that rebuilds, commits the base with all batches; later ones read the
    new files alone, however late they are and whatever day they are named for. Run it as often
    as batches arrive. ``newest_only`` keeps one version of a workout of a load;
    ``read_silver_workouts`` does so over all loads.
    """
    src, dst = lake.bronze("workouts"), lake.silver("workouts")
    by = ["start_month", "user_id", "start_time"]
    base = read_table(spark, lake.bronze("workouts_base"))
    first = rebuild or not read_commits(spark, dst)
    out: list[Commit] = []
    while True:
        listed = listed_files(spark, src, exclude=BASE_FILE) if first else new_files(spark, src, dst, exclude=BASE_FILE, most=max_files)
        files = pinned(listed)
        names = file_names(files)
        if not names and not first:
            return out
        increments = read_increments(spark, src, None, files=names)
        sets = build_silver_workouts(base if first else base.limit(0), increments, user_id, newest_only, keep_nested)
        sets = sets.withColumn("start_month", month_of("start_time"))
        out.append(commit_rows(sets, dst, ["start_month"], ranged_by=by, files=files, replaces=["*"] if first else []))
        first = False


def read_silver_workouts(spark: SparkSession, lake: Lake, newest_only: bool = False) -> DataFrame:
    """The committed sets, from batch loads and streams. ``newest_only`` keeps the latest version of
    each workout that came again: by its change time, then by the order of the loads. Sets
    without a workout id, such as those of the base, stay."""
    dst = lake.silver("workouts")
    sets = read_committed(spark, dst, loaded_by=newest_only)
    if not newest_only:
        return sets
    order = spark.createDataFrame([(c.name, c.number) for c in read_commits(spark, dst)], f"{LOADED_BY} STRING, load_number LONG")
    versions = sets.filter("id IS NOT NULL").select("id", "updated_at", LOADED_BY).distinct().join(order, LOADED_BY)
    newest = versions.groupBy("id").agg(F.max(F.struct(to_utc("updated_at"), "load_number", "updated_at", LOADED_BY)).alias("last"))
    last = newest.select("id", "last.updated_at", f"last.{LOADED_BY}")
    same = sets["id"].eqNullSafe(last["id"]) & sets["updated_at"].eqNullSafe(last["updated_at"]) & (sets[LOADED_BY] == last[LOADED_BY])
    kept = sets.filter("id IS NOT NULL").join(last, same, "left_semi")
    return kept.unionByName(sets.filter("id IS NULL")).drop(LOADED_BY)


def build_silver_users(raw: DataFrame) -> DataFrame:
    users = normalize_columns(raw, hyphen=False)
    return distinct_rows(coerce(users, {"data_nascimento": "timestamp_ntz"}))


def run_silver_users(spark: SparkSession, lake: Lake, day: date, fmt: str = "parquet") -> None:
    raw = read_latest(spark, lake.bronze("users_form"), fmt)
    write_snapshot(build_silver_users(raw), lake.silver("users"), day)


def build_silver_catalog(raw: DataFrame) -> DataFrame:
    return clean_text(raw)


def run_silver_catalog(spark: SparkSession, lake: Lake, day: date) -> None:
    raw = read_latest(spark, lake.bronze("catalog"))
    write_snapshot(build_silver_catalog(raw), lake.silver("catalog"), day)


def build_silver_mapping(raw: DataFrame, min_score: float = 5) -> DataFrame:
    """Distinct title pairs with a good score; a missing or unreadable score is dropped."""
    mapping = rename(normalize_columns(raw, hyphen=False, fold=True), MAPPING_RENAMES)
    mapping = distinct_rows(mapping)
    if "score" in mapping.columns:
        mapping = filter_min(coerce(mapping, {"score": "double"}), "score", min_score)
    return mapping


def run_silver_mapping(spark: SparkSession, lake: Lake) -> None:
    raw = read_csv(spark, lake.bronze("mapping"))
    write_table(build_silver_mapping(raw), lake.silver("mapping"))


def build_silver_gym(raw: DataFrame, ts: Column | None = None) -> DataFrame:
    """Exercises with real lists, one row per title, with a readable id."""
    gym = normalize_columns(raw)
    lists = {c: parse_list(F.col(c).cast("string")) for c in LIST_COLUMNS if c in gym.columns}
    gym = clean_categories(gym.withColumns(lists), GYM_CATEGORIES)
    name = next((c for c in ("title", "exercise_name") if c in gym.columns), None)
    if name is not None:
        order = [F.col(f"`{c}`").asc_nulls_last() for c in gym.columns if c != name]
        gym = first_per_key(gym, [name], order)
    if "title" in gym.columns:
        gym = gym.withColumn("exercise_id", slug("title"))
    else:
        gym = ensure_id(gym, "exercise_id", order=gym.columns)
    return with_ingestion_ts(gym, "ingestion_date", ts)


def run_silver_gym(spark: SparkSession, lake: Lake, ts: Column | None = None) -> None:
    raw = read_latest(spark, lake.bronze("gym_exercises"))
    write_table(build_silver_gym(raw, ts), lake.silver("gym_exercises"))


def build_silver_profiles(raw: DataFrame, as_of: Column, ts: Column | None = None) -> DataFrame:
    """Typed profiles with body-mass index and age, the latest one per user.

    A row without registration date counts as the latest.
    """
    users = normalize_columns(rename(raw, PROFILE_RENAMES))
    types = {"data_registro": "timestamp_ntz", "data_nascimento": "timestamp_ntz"}
    users = coerce(users, {**types, **dict.fromkeys(PROFILE_NUMBERS, "double")})
    users = with_bmi(users)
    if "data_nascimento" in users.columns:
        users = users.withColumn("idade_anos", age_years("data_nascimento", as_of))
    users = with_ingestion_ts(clean_categories(users, PROFILE_CATEGORIES), "silver_ingestion_ts_utc", ts)
    users = ensure_id(users, "user_id", order=users.columns, alt="id")
    return latest_per_key(users, "user_id", "data_registro", nulls="win")


def run_silver_profiles(spark: SparkSession, lake: Lake, as_of: Column, ts: Column | None = None) -> None:
    raw = read_latest(spark, lake.bronze("user_profiles"))
    write_table(build_silver_profiles(raw, as_of, ts), lake.silver("user_profiles"))


def merge_silver_profiles(spark: SparkSession, lake: Lake, as_of: Column, buckets: int = BUCKETS) -> list[int]:
    """``run_silver_profiles`` on a table by buckets of the user: a delivery rewrites only the buckets
    in which it has a row that is new or other than before. Returns them. A user whom the delivery
    lacks stays as it was; the time of loading says when a row last changed."""
    path = lake.silver("user_profiles_by_bucket")
    stamp = "silver_ingestion_ts_utc"
    new = build_silver_profiles(read_latest(spark, lake.bronze("user_profiles")), as_of)
    if not read_pointer(spark, path):
        write_buckets(new, path, "user_id", buckets)
        return sorted(read_pointer(spark, path).versions)
    old = read_buckets(spark, path)
    # A column that is new to the table makes every row another one.
    same = [old[c].eqNullSafe(new[c]) if c in old.columns else F.lit(False) for c in new.columns if c != stamp]
    changed = cut_lineage(new.join(old, reduce(lambda a, b: a & b, same), "left_anti"))

    def replace(before: DataFrame, own: DataFrame) -> DataFrame:
        kept = before.join(own.select("user_id").distinct(), "user_id", "left_anti")
        return kept.unionByName(own, allowMissingColumns=True)

    return merge_buckets(spark, path, changed, replace)
