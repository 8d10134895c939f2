"""Accounts and profiles of the application."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.functions.text import canonical_email
from trainlake.operators.joins import insert_new_accounts, upsert_profiles
from trainlake.plans.lake import Lake
from trainlake.session import cut_lineage
from trainlake.sources.buckets import BUCKETS, merge_buckets, read_buckets, write_buckets
from trainlake.sources.readers import read_latest_snapshot
from trainlake.sources.writers import append_batch, write_snapshot


def known_changes(users: DataFrame, changes: DataFrame, key: str = "user_id") -> DataFrame:
    """The changes whose user has an account; all others are dropped, as the upsert drops them."""
    return changes.join(users.select(key).dropna().distinct(), key, "left_semi")


def run_profile_changes(
    spark: SparkSession,
    lake: Lake,
    changes: DataFrame,
    day: date,
    changed_fields: str | None = None,
    stamp: Column | None = None,
) -> None:
    """Apply the changes to the newest accounts, write them as the accounts of ``day``, and add
    the changes of known users to the log under ``dt=<day>``.

    The accounts are written before the log: a run that fails in between is run again, and gives
    the same accounts. Names and order of the log's columns are those of the changes; without an
    ``updated_at`` the log gets ``stamp`` under that name, by default the time of the run.
    """
    users = read_latest_snapshot(spark, lake.gold("users_app")).drop("snapshot_date")
    log = known_changes(users, changes)
    if "updated_at" not in log.columns:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        log = log.withColumn("updated_at", now if stamp is None else stamp)
        changes = log
    write_snapshot(upsert_profiles(users, changes, changed_fields=changed_fields), lake.gold("users_app"), day)
    append_batch(log, lake.bronze("user_form"), day)


def run_new_accounts(spark: SparkSession, lake: Lake, new: DataFrame, day: date, created_at: Column | None = None) -> None:
    """Write the accounts of ``day``: the newest ones and the new ones."""
    users = read_latest_snapshot(spark, lake.gold("users_app")).drop("snapshot_date")
    write_snapshot(insert_new_accounts(users, new, created_at), lake.gold("users_app"), day)


def create_accounts(spark: SparkSession, lake: Lake, buckets: int = BUCKETS) -> None:
    """The accounts table by buckets of the user, from the newest snapshot of the accounts."""
    users = read_latest_snapshot(spark, lake.gold("users_app")).drop("snapshot_date")
    write_buckets(users, lake.gold("accounts"), "user_id", buckets)


def merge_profile_changes(
    spark: SparkSession,
    lake: Lake,
    changes: DataFrame,
    day: date,
    changed_fields: str | None = None,
    stamp: Column | None = None,
) -> list[int]:
    """``run_profile_changes`` on the bucketed accounts: only the buckets with a changed user are read
    and written. Returns them. ``changes`` is read three times; write it before if that is dear."""
    path = lake.gold("accounts")
    if "updated_at" not in changes.columns:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        changes = changes.withColumn("updated_at", now if stamp is None else stamp)

    def merge(users: DataFrame, own: DataFrame) -> DataFrame:
        return upsert_profiles(users, own, changed_fields=changed_fields)

    touched = merge_buckets(spark, path, changes, merge)
    if touched:
        append_batch(known_changes(read_buckets(spark, path, touched), changes), lake.bronze("user_form"), day)
    return touched


def merge_new_accounts(spark: SparkSession, lake: Lake, new: DataFrame, created_at: Column | None = None) -> list[int]:
    """``run_new_accounts`` on the bucketed accounts: of the registered ones only the e-mails are
    read, and only the buckets that get an account are written. Returns them."""
    path = lake.gold("accounts")
    users = read_buckets(spark, path)
    fresh = insert_new_accounts(users.limit(0), new, created_at)
    known = users.select(canonical_email("email").alias("email")).distinct()
    fresh = cut_lineage(fresh.join(known, "email", "left_anti").select(*users.columns))
    return merge_buckets(spark, path, fresh, lambda old, own: old.unionByName(own))
