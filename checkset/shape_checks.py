"""Renaming, column selection, filters and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables, with_views
from trainlake.functions.dates import month_of
from trainlake.operators import shape as sh
from trainlake.schemas import FACT_ORDER


@query("SELECT s_suppkey AS supplier_key, s_name AS codigo_nome, s_acctbal AS acct_bal FROM supplier")
def normalize_columns(t: Tables) -> DataFrame:
    raw = t.supplier.select(
        F.col("s_suppkey").alias(" Supplier Key "),
        F.col("s_name").alias("Código-Nome".replace("ó", "o")),
        F.col("s_acctbal").alias("Acct bál"),
    )
    return sh.normalize_columns(raw, fold=True)


@query("SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus FROM orders")
def rename(t: Tables) -> DataFrame:
    names = {"o_orderkey": "id", "o_custkey": "user_id", "absent": "nothing"}
    return sh.rename(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), names)


@query(
    """SELECT event_id AS id, value, event_type, NULL AS quality FROM events
    UNION ALL SELECT doc_id, CAST(toxic AS DOUBLE), NULL, quality FROM labels"""
)
def union_aligned(t: Tables) -> DataFrame:
    events = t.events.select(F.col("event_id").alias("id"), "value", "event_type")
    labels = t.labels.select("quality", F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("value"))
    return sh.union_aligned(events, labels)


@query(
    """SELECT event_id AS id, ts FROM events UNION ALL SELECT o_orderkey, o_orderdate FROM orders
    UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem"""
)
def concat_batches(t: Tables) -> DataFrame:
    return sh.concat_batches(
        [
            t.events.select(F.col("event_id").alias("id"), "ts"),
            t.orders.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id")),
            t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts")),
        ]
    )


@query(with_views("sets", "SELECT user_id, exercise_title, reps FROM sets"))
def keep_existing(t: Tables) -> DataFrame:
    return sh.keep_existing(t.sets(), ["user_id", "exercise_title", "reps", "not_there"])


@query(
    with_views(
        "sets",
        "SELECT * FROM sets",
    )
)
def order_columns(t: Tables) -> DataFrame:
    sets = sh.require_columns(t.sets(), ["user_id", "start_time"])
    return sh.order_columns(sets, FACT_ORDER)


@query(with_views("sets", "SELECT exercise_title, count(*) AS n FROM sets GROUP BY exercise_title"))
def resolve_column(t: Tables) -> DataFrame:
    sets = t.sets()
    name = sh.resolve_column(sets, ["movement", "EXERCISE"])
    return sets.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_acctbal * 2 AS doubled, upper(c_name) AS loud FROM customer")
def select_expr(t: Tables) -> DataFrame:
    return sh.select_expr(t.customer, "c_custkey", "c_acctbal * 2 AS doubled", "upper(c_name) AS loud")


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
      CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS score FROM lineitem
    WHERE CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END >= 5"""
)
def min_filter(t: Tables) -> DataFrame:
    scored = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("score"),
    )
    return sh.filter_min(scored, "score", 5)


@query("SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def incremental_filter(t: Tables) -> DataFrame:
    since = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return sh.filter_since(t.events.select("event_id", "ts", "event_type"), since, "ts")


@query(
    """SELECT event_id, event_type FROM events
    WHERE event_type IN ('error', 'signup') OR date_trunc('second', ts) > TIMESTAMP '2024-01-15 00:00:00'"""
)
def incremental_filter_fallback(t: Tables) -> DataFrame:
    kind, text = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = t.events.select(
        "event_id",
        "event_type",
        F.when(kind == "error", F.lit("unreadable")).when(kind == "view", F.lit("")).when(kind != "signup", text).alias("updated_at"),
        F.when(kind != "signup", text).alias("created_at"),
    )
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return sh.filter_since(raw, since, fallback="created_at").select("event_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 42")
def user_filter(t: Tables) -> DataFrame:
    return sh.for_user(t.events.select("event_id", "user_id", "value"), "42")


@query(
    with_views(
        "workouts",
        """SELECT workout_id, user_id, muscle_group FROM workouts
        WHERE date IS NOT NULL AND muscle_group IS NOT NULL""",
    )
)
def drop_null_rows(t: Tables) -> DataFrame:
    return sh.drop_null(t.workouts(), ["date", "muscle_group"]).select("workout_id", "user_id", "muscle_group")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def constant_predicate(t: Tables) -> DataFrame:
    t.part.createOrReplaceTempView("catalogue_rows")
    return t.spark.sql("SELECT p_partkey, p_name FROM catalogue_rows WHERE p_type = 'PROMO'")


@query(
    with_views(
        "accounts",
        """SELECT s_suppkey, coalesce(a.user_id, 'test_user_001') AS user_id
        FROM supplier LEFT JOIN accounts a
          ON lower(replace(s_name, 'Supplier#00000', 'Customer#00000')) || '@example.com' = a.email""",
    )
)
def account_lookup(t: Tables) -> DataFrame:
    known = F.regexp_replace("s_name", "Supplier#00000", "Customer#00000")
    asked = t.supplier.select("s_suppkey", F.concat(F.lit(" "), F.upper(known), F.lit("@Example.com")).alias("email"))
    return sh.user_ids_for(asked, t.accounts(), default="test_user_001").drop("email")


@query(
    """SELECT event_id, label FROM events JOIN (VALUES ('click', 'Clique'), ('view', 'Vista'))
      AS v(event_type, label) USING (event_type)"""
)
def row_literals(t: Tables) -> DataFrame:
    rows = sh.from_rows(t.spark, [("click", "Clique"), ("view", "Vista")], "event_type STRING, label STRING")
    return t.events.join(rows, "event_type").select("event_id", "label")


@query(
    """SELECT 'both' AS side, c_custkey AS key FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
    UNION ALL SELECT 'only_customer', c_custkey FROM customer
      WHERE c_custkey NOT IN (SELECT user_id FROM events)"""
)
def key_sets(t: Tables) -> DataFrame:
    events = t.events.select(F.col("user_id").alias("key"))
    customers = t.customer.select(F.col("c_custkey").alias("key"))
    both, only = sh.key_sets(events, customers, "key")
    return both.select(F.lit("both").alias("side"), "key").unionAll(
        only.select(F.lit("only_customer").alias("side"), "key")
    )


@query(
    """SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month FROM events
    UNION ALL SELECT NULL, DATE '1970-01-01'""",
    dates=["month"],
)
def union_all(t: Tables) -> DataFrame:
    t.events.select("user_id", month_of("ts").alias("month")).createOrReplaceTempView("event_months")
    return t.spark.sql("SELECT * FROM event_months UNION ALL SELECT NULL, DATE '1970-01-01'")
