"""Scans and sinks: each query writes given tables to the shared folder and reads them back."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables, with_views
from trainlake.operators.metrics import high_water_mark
from trainlake.operators.nested import explode_workouts
from trainlake.operators.shape import filter_since
from trainlake.plans.gold import build_metrics
from trainlake.sources import readers as rd
from trainlake.sources import state as st
from trainlake.sources import writers as wr
from trainlake.sources.csv_records import quoted_lines
from trainlake.sources.zones import write_zones

DAY = date(2024, 6, 15)
NEXT_DAY = date(2024, 6, 16)


def write_csv(df: DataFrame, path: str) -> str:
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)
    return path


FLAT_SQL = """SELECT CAST(user_id AS INTEGER) AS user_id, title,
      strftime(start_time, '%-d %b %Y, %H:%M') AS start_time,
      strftime(end_time, '%-d %b %Y, %H:%M') AS end_time, CAST(NULL AS VARCHAR) AS description,
      exercise_title, CAST(NULL AS INTEGER) AS superset_id, CAST(NULL AS VARCHAR) AS exercise_notes,
      set_index, set_type, weight_kg, reps,
      CASE WHEN set_type = 'A' THEN CAST(reps AS DOUBLE) END AS distance_km,
      CAST(NULL AS DOUBLE) AS duration_seconds, CAST(rpe AS DOUBLE) AS rpe FROM sets"""


@query(with_views("sets", FLAT_SQL))
def workout_csv_scan(t: Tables) -> DataFrame:
    return rd.read_workout_csv(t.spark, write_csv(t.flat_sets(), t.scratch("workouts_csv")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_scan(t: Tables) -> DataFrame:
    path = write_csv(t.documents, t.scratch("documents_csv"))
    return rd.read_csv(t.spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_scan_inferred(t: Tables) -> DataFrame:
    return rd.read_csv(t.spark, write_csv(t.supplier, t.scratch("supplier_csv")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def parquet_scan(t: Tables) -> DataFrame:
    return rd.read_table(t.spark, f"{t.sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def latest_snapshot_scan(t: Tables) -> DataFrame:
    prefix = t.scratch("snapshots")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    wr.write_table(orders.filter("o_orderstatus = 'F'"), f"{prefix}/orders_20240614")
    wr.write_table(orders, f"{prefix}/orders_20240615")
    return rd.read_latest(t.spark, prefix)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def latest_partitioned_scan(t: Tables) -> DataFrame:
    prefix = t.scratch("tables")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    wr.write_table(orders.limit(10), f"{prefix}/orders_20240614")
    wr.write_table(orders, f"{prefix}/orders_20240615", partition_by=["o_orderstatus"])
    return rd.read_latest(t.spark, prefix)


@query("SELECT o_orderkey, o_custkey, 20240616 AS snapshot_date FROM orders")
def snapshot_new_column(t: Tables) -> DataFrame:
    path = t.scratch("dated")
    wr.write_snapshot(t.orders.select("o_orderkey"), path, DAY)
    wr.write_snapshot(t.orders.select("o_orderkey", "o_custkey"), path, NEXT_DAY)
    return rd.read_latest_snapshot(t.spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey FROM orders")
def append_new_column(t: Tables) -> DataFrame:
    path = t.scratch("log")
    wr.append_rows(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"), path)
    wr.append_rows(t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey"), path)
    return rd.read_appended(t.spark, path)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'O' THEN 'api' END AS source,
      CASE WHEN o_orderstatus = 'F' THEN 'someone' ELSE CAST(o_custkey AS VARCHAR) END AS user_id
    FROM orders WHERE o_orderstatus <> 'P'"""
)
def increment_columns(t: Tables) -> DataFrame:
    """Batches of many users, of one user's folder, and with a column that others lack."""
    prefix = t.scratch("increments")
    nested = t.landed_nested()
    wr.append_batch(nested.filter("routine_id = 'O'").withColumn("source", F.lit("api")), prefix, DAY)
    wr.write_table(nested.filter("routine_id = 'F'").drop("user_id"), f"{prefix}/user=someone/dt=20240615")
    wr.write_table(nested.filter("routine_id = 'P'"), f"{prefix}/base_full.parquet")
    return rd.read_increments(t.spark, prefix).select("id", "source", "user_id")


@query("SELECT doc_id, text, source FROM documents")
def csv_line_ends(t: Tables) -> DataFrame:
    """Texts with line ends and quotes by the typed scan; the read fails if it garbles one."""
    path = write_csv(t.documents.select("doc_id", "text", "source"), t.scratch("documents_csv"))
    return rd.read_csv(t.spark, path, "doc_id BIGINT, text STRING, source STRING", multi_line=True)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_split_scan(t: Tables) -> DataFrame:
    """One file, read in byte ranges of 16 kB, or for a large file in some 500, so that most ranges
    begin inside a record."""
    path = write_csv(t.documents.coalesce(1), t.scratch("documents_csv"))
    ranged = t.spark.newSession()
    size = rd.file_listing(t.spark, path, "*.csv").agg(F.sum("length")).first()[0] or 0
    ranged.conf.set("spark.sql.files.maxPartitionBytes", str(max(16384, size >> 9)))
    ranged.conf.set("spark.sql.files.openCostInBytes", "0")
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        ranged.conf.set(key, t.spark.conf.get(key))
    if quoted_lines(ranged, path).select("block").distinct().limit(9).count() < 9:
        raise ValueError("the file is read in few ranges")
    return rd.read_csv(ranged, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("SELECT event_id AS id, value, NULL AS toxic FROM events UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def folder_union_scan(t: Tables) -> DataFrame:
    prefix = t.scratch("folder")
    wr.write_table(t.events.select(F.col("event_id").alias("id"), "value"), f"{prefix}/a")
    wr.write_table(t.labels.select(F.col("doc_id").alias("id"), "toxic"), f"{prefix}/b")
    return rd.read_folder(t.spark, prefix)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS routine_id FROM orders
    WHERE o_orderstatus <> 'P'"""
)
def increment_scan(t: Tables) -> DataFrame:
    prefix = t.scratch("increments")
    nested = t.landed_nested()
    wr.write_table(nested.filter("routine_id = 'O'"), f"{prefix}/user=a/dt=20240615")
    wr.write_table(nested.filter("routine_id = 'F'"), f"{prefix}/user=b/dt=20240615")
    wr.write_table(nested.filter("routine_id = 'P'"), f"{prefix}/base_full.parquet")
    return rd.read_increments(t.spark, prefix).select("id", "routine_id")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def scan_by_extension(t: Tables) -> DataFrame:
    csv = write_csv(t.supplier.select("s_suppkey", "s_name"), t.scratch("supplier") + ".csv")
    first = rd.read_any(t.spark, csv, "s_suppkey BIGINT, s_name STRING")
    second = rd.read_any(t.spark, f"{t.sf_dir}/customer.parquet").select("c_custkey", "c_name")
    return first.unionAll(second)


@query(
    with_views(
        "nested",
        """SELECT id, user_id, start_time, exercise_title, set_index, weight_kg FROM nested""",
    )
)
def workout_pages(t: Tables) -> DataFrame:
    path = t.scratch("pages")
    nested = t.landed_nested()
    # Up to ten workouts a page, in the order of their ids.
    workout = F.struct(*[F.col(c) for c in nested.columns])
    page = nested.groupBy((F.col("id").cast("long") / 10).cast("int").alias("page")).agg(F.array_sort(F.collect_list(workout)).alias("workouts"))
    page = page.select("page", F.lit(0).alias("page_count"), "workouts")
    page.write.json(path)
    users = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"))
    workouts = rd.read_workout_pages(t.spark, path).join(users, "id")
    return explode_workouts(workouts).select(
        "id", "user_id", "start_time", "exercise_title", "set_index", "weight_kg"
    )


@query("SELECT CASE WHEN c_nationkey > 5 THEN 'u' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS user_id, c_name FROM customer")
def normalize_documents(t: Tables) -> DataFrame:
    user = F.when(F.col("c_nationkey") > 5, F.concat(F.lit("u"), F.col("c_custkey")))
    return rd.normalize_documents(t.customer.select(F.col("c_custkey").alias("_id"), user.alias("user_id"), "c_name"))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'click' AND value > 100)")
def watermark_state(t: Tables) -> DataFrame:
    path = t.scratch("state")
    st.write_watermark(t.spark, path, datetime(2020, 1, 1, tzinfo=timezone.utc))
    clicks = t.events.filter("event_type = 'click' AND value > 100")
    mark = high_water_mark(clicks, "ts").first()[0]
    st.write_watermark(t.spark, path, mark)
    since = F.lit(st.read_watermark(t.spark, path).replace(tzinfo=None)).cast("timestamp_ntz")
    return filter_since(t.events.select("event_id", "ts"), since, "ts")


@query(with_views("sets", "SELECT CAST(user_id AS VARCHAR) AS user_id, id, set_index, weight_kg FROM sets WHERE user_id = 7"))
def fact_for_user_by_zones(t: Tables) -> DataFrame:
    """One user's rows from the files that the zone map names."""
    path = t.scratch("fact")
    sets = t.sets().select(F.col("user_id").cast("string").alias("user_id"), "id", "set_index", "weight_kg")
    wr.write_table(sets, path, ranged_by=["user_id", "id"])
    write_zones(t.spark, path, ["user_id"])
    return rd.load_fact(t.spark, path, "7")


@query(with_views("sets", "SELECT user_id, id, set_index, weight_kg FROM sets WHERE user_id = 7"))
def fact_for_user(t: Tables) -> DataFrame:
    path = t.scratch("fact")
    wr.write_table(t.sets().select("user_id", "id", "set_index", "weight_kg"), path, ranged_by=["user_id", "id"])
    return rd.load_fact(t.spark, path, "7")


@query("SELECT o_orderkey, o_orderstatus, 2024 AS year, 6 AS month, CASE WHEN o_orderstatus = 'O' THEN 15 ELSE 16 END AS day FROM orders")
def day_partition(t: Tables) -> DataFrame:
    path = t.scratch("days")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    wr.write_day(orders, path, DAY)
    wr.write_day(orders.filter("o_orderstatus = 'O'"), path, DAY)
    wr.write_day(orders.filter("o_orderstatus <> 'O'"), path, NEXT_DAY)
    return rd.read_table(t.spark, path)


@query("SELECT event_id, value, event_type AS \"user\", CASE WHEN value > 50 THEN 20240615 ELSE 20240616 END AS dt FROM events")
def append_batch(t: Tables) -> DataFrame:
    path = t.scratch("batches")
    events = t.events.select("event_id", "value", F.col("event_type").alias("account"))
    wr.append_batch(events.filter("value > 50"), path, DAY, user="account", by_user=True)
    wr.append_batch(events.filter("value <= 50"), path, NEXT_DAY, user="account", by_user=True)
    return rd.read_table(t.spark, path).drop("account")


@query("SELECT c_custkey, c_name, 20240616 AS snapshot_date FROM customer")
def dated_snapshot(t: Tables) -> DataFrame:
    path = t.scratch("dated")
    customers = t.customer.select("c_custkey", "c_name")
    wr.write_snapshot(t.customer.filter("c_nationkey > 5").select("c_custkey", "c_name"), path, DAY)
    wr.write_snapshot(customers, path, NEXT_DAY)
    wr.write_snapshot(customers, path, NEXT_DAY)
    return rd.read_latest_snapshot(t.spark, path)


@query("SELECT l_orderkey, l_partkey, l_extendedprice, l_returnflag FROM lineitem")
def overwrite_table(t: Tables) -> DataFrame:
    path = t.scratch("table")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    wr.write_table(lines.filter("l_returnflag = 'A'"), path)
    wr.write_table(lines, path, partition_by=["l_returnflag"], sort=["l_partkey"])
    return rd.read_table(t.spark, path)


@query("SELECT event_id, ts, value FROM events UNION ALL SELECT event_id, ts, value FROM events WHERE event_type = 'view'")
def append_rows(t: Tables) -> DataFrame:
    path = t.scratch("log")
    events = t.events.select("event_id", "ts", "value")
    wr.append_rows(events, path)
    wr.append_rows(t.events.filter("event_type = 'view'").select("event_id", "ts", "value"), path)
    return rd.read_table(t.spark, path)


METRICS_SQL = """, days AS (SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS key, count(*) AS n,
      sum(weight_kg * reps) AS v FROM sets GROUP BY 1)
    SELECT 'volume_por_dia' AS metric, key, CAST(v AS DOUBLE) AS value FROM days
    UNION ALL SELECT 'workouts_por_dia', key, CAST(n AS DOUBLE) FROM days
    UNION ALL SELECT * FROM (SELECT 'exercicios_mais_frequentes', exercise_title, CAST(count(*) AS DOUBLE) AS n
      FROM sets GROUP BY 2 ORDER BY n DESC, 2 LIMIT 50)"""


@query(with_views("sets", METRICS_SQL))
def metrics_document(t: Tables) -> DataFrame:
    path = t.scratch("metrics")
    wr.write_metrics(build_metrics(t.sets()), path)
    return rd.read_metrics(t.spark, path)


@query("SELECT event_id, event_type, value FROM events")
def jsonl_sink(t: Tables) -> DataFrame:
    path = t.scratch("jsonl")
    events = t.events.select("event_id", "event_type", "value")
    wr.write_jsonl(events.filter("event_type = 'view'"), path, DAY, user="a")
    wr.write_jsonl(events.filter("event_type <> 'view'"), path, DAY, user="b")
    rows = t.spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE").json(f"{path}/dt=20240615/*")
    return rows


@query("SELECT doc_id, text, lang FROM documents")
def land_csv(t: Tables) -> DataFrame:
    src, dst = write_csv(t.documents.select("doc_id", "text", "lang"), t.scratch("feed")), t.scratch("landed")
    wr.land_csv(t.spark, src, dst, DAY, "doc_id BIGINT, text STRING, lang STRING")
    return rd.read_latest_snapshot(t.spark, dst).drop("snapshot_date")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def materialized_model(t: Tables) -> DataFrame:
    wr.materialize(t.part, "parts_view", "view")
    counts = t.spark.sql("SELECT p_type, count(*) AS n FROM parts_view GROUP BY p_type")
    return wr.materialize(counts, "part_type_counts", "table", t.scratch("part_type_counts"))
