"""Joins between facts, dimensions and change tables.

No side is broadcast by hint. Catalyst broadcasts a side whose measured size is below the
session's threshold; a larger one is shuffled, and AQE splits the hot keys of that join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.functions.text import canonical_email, strip
from trainlake.operators.keys import first_per_key, latest_per_key, surrogate_key, time_order
from trainlake.operators.shape import key_marks, lookup, require_columns, resolve_column
from trainlake.schemas import CATALOG_COLUMNS, PROFILE_FIELDS

PROFILE_TIME_COLUMNS = ("updated_at", "data_registro", "last_update")


def join_mapping(fact: DataFrame, mapping: DataFrame, null_keys_match: bool = True) -> DataFrame:
    """Add the mapped name and key to each set; a title mapped twice gives two rows."""
    require_columns(mapping, ["exercise_title_heavy", "exercise_name_kaggle", "sk_exercise"])
    pairs = mapping.select("exercise_title_heavy", "exercise_name_kaggle", "sk_exercise")
    return lookup(fact, pairs, "exercise_title", "exercise_title_heavy", null_keys_match)


def one_per_exercise(catalog: DataFrame, key: str = "exercise_name_kaggle") -> DataFrame:
    """Catalogue columns of the first row of each exercise, in the order of the columns."""
    cols = [c for c in CATALOG_COLUMNS if c in catalog.columns]
    rest = [F.col(c).asc_nulls_last() for c in cols if c != key]
    return first_per_key(catalog.select(*cols), [key], rest)


def enrich_muscles(fact: DataFrame, catalog: DataFrame, null_keys_match: bool = True) -> DataFrame:
    """Add muscles and equipment; the row count of the fact never changes."""
    key = "exercise_name_kaggle"
    dim = one_per_exercise(catalog, key).withColumnRenamed(key, "_dim_key")
    return lookup(fact, dim, key, "_dim_key", null_keys_match)


def build_dim_exercise(
    mapping: DataFrame,
    catalog: DataFrame,
    null_keys_match: bool = True,
) -> DataFrame:
    """Mapping rows with every distinct muscle and equipment of their exercise.

    A mapping without ``sk_exercise`` gets a dense one over all columns.
    """
    names = catalog.select("Exercise Name", "Main_muscle", "Equipment").distinct()
    names = names.withColumnRenamed("Exercise Name", "_dim_key")
    dim = lookup(mapping, names, "exercise_name_kaggle", "_dim_key", null_keys_match)
    if "sk_exercise" not in dim.columns:
        dim = surrogate_key(dim, "sk_exercise", order=dim.columns)
    return dim


def with_empty_details(parent: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """The details, and one row of NULLs for each parent key that has none.

    An inner join with the result equals the left join. A left join can neither broadcast
    its left side nor split a hot key of its right side; an inner join can do both.
    """
    parents = parent.select(key).dropna().distinct()
    lonely = parents.join(details.select(key).dropna().distinct(), key, "left_anti")
    return details.unionByName(lonely, allowMissingColumns=True)


def gold_view(exercises: DataFrame, muscles: DataFrame, instructions: DataFrame) -> DataFrame:
    """Each exercise with every pair of its muscles and steps."""
    key = "exercise_id"
    dim = exercises.select(key, "exercise_name", "equipment", "main_muscle")
    muscle = with_empty_details(dim, muscles.select(key, "muscle"), key)
    step = with_empty_details(dim, instructions.select(key, "step_number", "instruction"), key)
    view = dim.join(muscle, key).join(step, key)
    return view.unionByName(dim.filter(F.col(key).isNull()), allowMissingColumns=True)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of ``a``, of ``b``, in both, and only in ``b``."""
    in_a, in_b = F.col("in_a").cast("int"), F.col("in_b").cast("int")

    def total(mark: Column, name: str) -> Column:
        return F.coalesce(F.sum(mark), F.lit(0)).alias(name)

    return key_marks(a, b, key).agg(
        total(in_a, "keys_a"),
        total(in_b, "keys_b"),
        total(in_a * in_b, "in_both"),
        total(in_b - in_a * in_b, "only_b"),
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row; a NULL key is an orphan.

    Both sides are made distinct before the join, so a hot key counts as one row there.
    """
    keys = fact.select(key).distinct()
    return keys.join(dim.select(key).dropna().distinct(), key, "left_anti")


def upsert_profiles(
    users: DataFrame,
    changes: DataFrame,
    key: str = "user_id",
    ts: str = "updated_at",
    fields: Sequence[str] = tuple(PROFILE_FIELDS),
    changed_fields: str | None = None,
) -> DataFrame:
    """Apply the changes to the users; changes of unknown users do nothing.

    A column the change table lacks stays as it is. With ``changed_fields``, an array
    column that names the fields a change sets, each field takes the value of the last
    change that sets it, NULL included; without it each change sets all its fields.
    """
    names = [f for f in fields if f in changes.columns and f in users.columns]
    ties = [F.col(f"`{n}`") for n in names]
    latest = []
    for n in names:
        order = F.struct(time_order(changes, ts).alias("_time"), *ties)
        if changed_fields is not None:
            order = F.when(F.array_contains(changed_fields, n), order)
        latest.append(F.max_by(F.struct(F.col(f"`{n}`").alias("v")), order).alias(f"_new_{n}"))
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*latest)
    joined = users.join(last, key, "left")
    out = []
    for c in users.columns:
        if c in names:
            new = F.col(f"`_new_{c}`")
            kind = users.schema[c].dataType
            out.append(F.when(new.isNotNull(), new["v"].cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)


def id_from_email(email: Column) -> Column:
    """Account id in UUID form, made from the e-mail: a retried task gives the same id."""
    digest = F.md5(email)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def insert_new_accounts(users: DataFrame, new: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Users plus the new accounts whose e-mail is not registered yet.

    An account needs a name and an e-mail; of two with one e-mail the first name wins.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if created_at is None else created_at
    asked = new.withColumn("email", canonical_email("email"))
    asked = asked.filter((F.col("email") != "") & (strip("nome") != ""))
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in asked.columns if c not in ("email", "nome")]
    asked = first_per_key(asked, ["email"], [F.col("nome").asc(), *rest])
    registered = users.select(canonical_email("email").alias("email")).distinct()
    fresh = asked.join(registered, "email", "left_anti").withColumns(
        {"user_id": id_from_email(F.col("email")), "created_at": stamp}
    )
    known = [c for c in fresh.columns if c in users.columns]
    return users.unionByName(fresh.select(*known), allowMissingColumns=True)


def latest_profiles(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Newest profile of each user by the first time column the table has."""
    ts = resolve_column(df, PROFILE_TIME_COLUMNS, contains=False)
    return latest_per_key(df, key, ts, nulls="lose")


def overlay(
    base: DataFrame,
    override: DataFrame,
    key: str = "user_id",
    fill: Sequence[str] = ("email",),
) -> DataFrame:
    """Base records with the fields of the override record put over them.

    A field of the override wins even when it is NULL; the ``fill`` columns fall back to
    the base when that leaves them empty. ``override`` has one row per key.
    """
    shared = [c for c in override.columns if c != key]
    marks = {c: f"_new_{c}" for c in shared}
    right = override.withColumnsRenamed(marks).withColumn("_hit", F.lit(True))
    joined = base.join(right, key, "left")
    out = [F.col(f"`{key}`")]
    for c in base.columns:
        if c == key:
            continue
        value = F.col(f"`{c}`")
        if c in shared:
            value = F.when(F.col("_hit"), F.col(f"`{marks[c]}`")).otherwise(value)
            if c in fill:
                value = F.coalesce(F.nullif(value, F.lit("")), F.col(f"`{c}`"))
        out.append(value.alias(c))
    out += [F.col(f"`{marks[c]}`").alias(c) for c in shared if c not in base.columns]
    return joined.select(*out)
