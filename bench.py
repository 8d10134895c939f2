"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (warm runs, the
median counts), BENCH_QUERIES (comma-separated names), BENCH_DUCKDB=1 to time the SQL of
each query on DuckDB next to it.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from checkset import ORACLE, QUERIES

HEADLINE = """
calendar coerce_types normalize_text clean_text parse_list duration_minutes
explode_sets distinct_rows first_per_key latest_per_key surrogate_key
mapped_sets enriched_sets fact_sets dim_exercise gold_view key_overlap orphans
upsert_profiles insert_new_accounts overlay
volume_per_day rows_per_day top_exercises gold_metrics
user_kpis weekly_frequency daily_sets rolling_mean muscle_share exercise_ranking
dow_muscle_matrix intensity_histogram training_summary top_categories last_rows
monthly_summary vs_global_mean progression summary_text profile_text column_profile
silver_workouts fact_job ingest_batches stream_sets
""".split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trainlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def median(fn, runs: int) -> float:
    fn()
    return round(statistics.median(timed(fn) for _ in range(runs)), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    times = {}
    for name in names:
        run = QUERIES[name]
        times[name] = median(lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save(), runs)
    result = {
        "metric": "sum of median warm query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
        "cpus": int(cpus),
    }
    if os.environ.get("BENCH_DUCKDB"):
        import duckdb

        from checkset.tables import NAMES

        con = duckdb.connect(config={"threads": int(cpus)})
        for table in NAMES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result["duckdb"] = {n: median(lambda n=n: con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLE[n]}"), runs) for n in names}
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
