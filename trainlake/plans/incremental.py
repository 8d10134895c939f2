"""Gold figures kept up to date by the loads that are new, without reading the history again.

The source is a committed table of workouts. For each of its loads a state table gets one commit of
the same name with the partial figures of the load's rows, so a load counts once however often
the job runs. Readers merge the states, which are a small share of the rows.

States add rows; they do not take any back. Where a workout can be delivered again in another
version, rebuild them from the newest versions (``rebuild=True``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from trainlake.operators import metrics as m
from trainlake.operators import states as st
from trainlake.plans.dashboard import USER, tables_from_rollup
from trainlake.sources.commits import commit_rows, live_commits, loads, read_commits, read_committed, read_load
from trainlake.sources.readers import read_table
from trainlake.sources.writers import write_table


def update_state(
    spark: SparkSession,
    src: str,
    dst: str,
    build: Callable[[DataFrame], DataFrame],
    rebuild: Callable[[], DataFrame] | None = None,
) -> list[str]:
    """Add the states of the loads of ``src`` that ``dst`` lacks, and return their names. ``rebuild``
    gives the rows of which the whole state is made anew, in place of all that was before."""
    if rebuild is not None:
        names = loads(spark, src)
        made = commit_rows(build(rebuild()), dst, replaces=["*"])
        # The loads that the rebuild has covered count as done.
        empty = read_committed(spark, dst).limit(0)
        return [made.name, *[c.name for c in (commit_rows(empty, dst, name=f"load-{n}") for n in names) if c]]
    known = {c.name for c in read_commits(spark, dst)}
    new = [n for n in loads(spark, src) if f"load-{n}" not in known]
    for name in new:
        commit_rows(build(read_load(spark, src, name)), dst, name=f"load-{name}")
    return new


def merged_state(spark: SparkSession, dst: str, keys: Sequence[str]) -> DataFrame:
    """The state of all loads, one row per key."""
    return st.merge_states(read_committed(spark, dst), keys)


def compact_state(spark: SparkSession, dst: str, keys: Sequence[str]) -> bool:
    """Store the merged state in place of the states of the loads; returns whether there was
    anything to merge."""
    live = live_commits(read_commits(spark, dst))
    if len([c for c in live if c.rows]) < 2:
        return False
    commit_rows(merged_state(spark, dst, keys), dst, replaces=[c.name for c in live], loaded=False)
    return True


def update_kpis(spark: SparkSession, src: str, base: str) -> DataFrame:
    """KPI row per user (``metrics.user_kpis``) over all loads of ``src``."""
    dst = f"{base.rstrip('/')}/activity_state"
    update_state(spark, src, dst, st.activity_state)
    return st.kpis_from_state(merged_state(spark, dst, (USER, st.WEEK)))


def update_summaries(spark: SparkSession, src: str, base: str) -> DataFrame:
    """History figures per user (``metrics.training_summary``) over all loads of ``src``."""
    dst = f"{base.rstrip('/')}/history_state"
    update_state(spark, src, dst, st.history_state)
    return st.summary_from_state(merged_state(spark, dst, (USER, st.WEEK)))


def update_dashboard(spark: SparkSession, src: str, base: str, keys: Sequence[str] = ("muscle_group",)) -> Mapping[str, str]:
    """The dashboard tables that come from the rollup by user, day and ``keys``, over all loads of
    ``src``: the rollup of a new load is merged with those of the others, and written once for
    all tables."""
    root = base.rstrip("/")
    update_state(spark, src, f"{root}/rollup_state", lambda rows: m.activity_rollup(rows, keys=keys))
    write_table(merged_state(spark, f"{root}/rollup_state", (USER, "day", *keys)), f"{root}/rollup", sort=[USER])
    tables = tables_from_rollup(read_table(spark, f"{root}/rollup"))
    paths = {name: f"{root}/{name}" for name in tables}
    for name, table in tables.items():
        write_table(table, paths[name], sort=[USER])
    return paths
