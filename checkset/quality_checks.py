"""Profiles, dictionaries and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables, with_views
from trainlake.descriptions import USERS
from trainlake.operators import quality as ql
from trainlake.sources import checked as ck
from trainlake.sources.commits import read_committed
from trainlake.sources.writers import write_table

_WORKOUT_COLUMNS = (
    ("workout_id", "bigint", "Numérica"),
    ("user_id", "bigint", "Numérica"),
    ("date", "timestamp_ntz", "Categórica"),
    ("muscle_group", "string", "Categórica"),
    ("total_reps", "int", "Numérica"),
)


def _profiled(t: Tables) -> DataFrame:
    return t.workouts().select(*[c for c, _, _ in _WORKOUT_COLUMNS])


def _profile_sql(extra: str = "") -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{d}' AS dtype, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_null{extra.format(c=c, k=k)} FROM workouts"
        for c, d, k in _WORKOUT_COLUMNS
    ]
    return with_views("workouts", " UNION ALL ".join(parts))


@query(_profile_sql(", CAST(min({c}) AS VARCHAR) AS sample"))
def column_profile(t: Tables) -> DataFrame:
    return ql.profile(_profiled(t))


_TEXTS = {c: USERS.get(c, f"Descrição da coluna {c}") for c, _, _ in _WORKOUT_COLUMNS}


@query(
    _profile_sql(
        ", CASE '{c}' "
        + " ".join(f"WHEN '{c}' THEN '{text}'" for c, text in _TEXTS.items())
        + " END AS description, '{k}' AS kind"
    )
)
def column_dictionary(t: Tables) -> DataFrame:
    rows = _profiled(t)
    counts = ql.profile(rows).select("column_name", "n_rows", "n_null")
    return ql.data_dictionary(rows, USERS).join(counts, "column_name")


_STATUS = {"user_id": "type", "total_reps": "ok", "date": "undeclared", "workout_id": "undeclared", "muscle_group": "ok"}


@query(
    _profile_sql(
        ", CASE '{c}' " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in _STATUS.items()) + " END AS status"
    )
)
def schema_contract(t: Tables) -> DataFrame:
    rows = _profiled(t)
    contract = "user_id STRING, muscle_group STRING, total_reps INT, notes STRING"
    checked = ql.check_schema(rows, contract).select("column_name", "status")
    return ql.profile(rows).drop("sample").join(checked, "column_name")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_check(t: Tables) -> DataFrame:
    return ql.check_unique(t.part, "p_name")


@query(with_views("workouts", "SELECT workout_id, user_id FROM workouts WHERE muscle_group IS NULL"))
def not_null_check(t: Tables) -> DataFrame:
    return ql.check_not_null(t.workouts(), "muscle_group").select("workout_id", "user_id")


@query(
    """SELECT o_orderstatus, count(*) > 0 AS passes, CASE WHEN count(*) = 0 THEN 'orders has no rows' END AS message
    FROM (SELECT DISTINCT o_orderstatus FROM orders UNION ALL SELECT 'none') s
    LEFT JOIN orders USING (o_orderstatus) WHERE o_orderstatus <> 'none' GROUP BY 1
    UNION ALL SELECT 'none', FALSE, 'orders has no rows'"""
)
def non_empty_guard(t: Tables) -> DataFrame:
    """The guard over the orders of each state, and of one that no order has."""
    out = []
    for (state,) in [*t.orders.select("o_orderstatus").distinct().collect(), ("none",)]:
        try:
            ql.require_rows(t.orders.filter(F.col("o_orderstatus") == state), "orders")
            out.append((state, True, None))
        except RuntimeError as refused:
            out.append((state, False, str(refused)))
    return t.spark.createDataFrame(out, "o_orderstatus STRING, passes BOOLEAN, message STRING")


@query(
    """SELECT 'l_returnflag=' || l_returnflag AS folder, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n_files,
      CAST(9 * count(*) AS BIGINT) AS n_bytes, TRUE AS is_new
    FROM lineitem GROUP BY 1"""
)
def file_inventory(t: Tables) -> DataFrame:
    """Text files of nine bytes a row, one per line number in each folder."""
    path = t.scratch("inventory")
    text = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 8, "0")).alias("value")
    for (number,) in t.lineitem.select("l_linenumber").distinct().collect():
        lines = t.lineitem.filter(F.col("l_linenumber") == number).select(text, "l_returnflag")
        lines.repartition(1).write.partitionBy("l_returnflag").mode("append").text(path)
    files = ql.file_inventory(t.spark, path)
    folder = F.regexp_extract("folder", "([^/]*)$", 1).alias("folder")
    return files.filter(F.col("folder").contains("=")).select(folder, "n_files", "n_bytes", (F.col("newest") > F.lit("2020-01-01").cast("timestamp")).alias("is_new"))


@query(
    """SELECT 'region' AS table_name, r_regionkey AS key, r_name AS name FROM region
    UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation"""
)
def layer_preview(t: Tables) -> DataFrame:
    layer = t.scratch("layer") + "/silver"
    write_table(t.region.select(F.lit("region").alias("table_name"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), f"{layer}/region")
    write_table(t.nation.select(F.lit("nation").alias("table_name"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), f"{layer}/nation")
    first, second = ql.layer_previews(t.spark, layer, n=25).values()
    return first.unionByName(second)


def _dtype_sql(table: str, name: str, columns: str) -> str:
    """Names and types of columns as the SQL engine sees them, and the files that the table has."""
    kinds = "CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"
    files = {"parts": "4", "users": "(SELECT count(DISTINCT c_mktsegment) FROM customer)"}[name]
    rows = [f"SELECT '{name}' AS table_name, '{c}' AS column_name, max({kinds.format(c=c)}) AS dtype, CAST({files} AS BIGINT) AS n_files FROM {table}" for c in columns.split()]
    return " UNION ALL ".join(rows)


@query(_dtype_sql("part", "parts", "p_partkey p_name") + " UNION ALL " + _dtype_sql("customer", "users", "c_custkey c_acctbal c_mktsegment"))
def layer_schema(t: Tables) -> DataFrame:
    layer = t.scratch("layer") + "/silver"
    t.part.select("p_partkey", "p_name").repartition(4).write.parquet(f"{layer}/parts")
    t.customer.select("c_custkey", "c_acctbal", "c_mktsegment").repartition(1).write.partitionBy("c_mktsegment").parquet(f"{layer}/users")
    return ql.layer_schemas(t.spark, layer)


@query(
    with_views(
        "workouts",
        """, judged AS (SELECT workout_id, user_id, total_sets, muscle_group, concat_ws(', ',
            CASE WHEN muscle_group IS NULL THEN 'muscle_group is there' END,
            CASE WHEN total_sets > 150 THEN 'total_sets from 0 to 150' END,
            CASE WHEN date IS NULL OR total_reps < 0 THEN 'dated and counted' END) AS broken FROM workouts)
        SELECT workout_id, user_id, total_sets, muscle_group, NULLIF(broken, '') AS broken FROM judged""",
    )
)
def quarantine(t: Tables) -> DataFrame:
    """Good rows as committed, and the others as set aside with the rules that they break, over two
    loads, the second of which is refused and delivered again."""
    path = t.scratch("workouts")
    rules = [ck.not_null("muscle_group"), ck.within("total_sets", 0, 150), ck.Rule("dated and counted", "date IS NOT NULL AND coalesce(total_reps, 0) >= 0", 0.5)]
    workouts = t.workouts().select("workout_id", "user_id", "date", "total_sets", "total_reps", "muscle_group")
    first, second = workouts.filter("pmod(workout_id, 3) = 0"), workouts.filter("pmod(workout_id, 3) <> 0")
    ck.commit_checked(first, path, rules, unique=["workout_id"], contract="workout_id BIGINT, muscle_group STRING")
    refused = None
    try:
        ck.commit_checked(second.withColumn("date", F.lit(None).cast("timestamp_ntz")), path, rules)
    except ck.Refused as fault:
        refused = fault.report.name
    if refused is None:
        raise ValueError("a load without dates has passed")
    ck.commit_checked(second, path, rules, unique=["workout_id"])
    cols = ["workout_id", "user_id", "total_sets", "muscle_group"]
    good = read_committed(t.spark, path).select(*cols, F.lit(None).cast("string").alias("broken"))
    aside = ck.read_quarantine(t.spark, path).filter(F.col("load_batch") != refused)
    return good.unionAll(aside.select(*cols, F.array_join("broken_rules", ", ").alias("broken")))
