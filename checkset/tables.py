"""The test tables, and the roles they play: workouts, sets, catalogue, mapping, profiles.

Measures are whole numbers or quarters, so that sums are exact in any order.

Each Spark view has an SQL twin of the same name in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.schemas import RAW_WORKOUT, WORKOUT_CSV
from trainlake.session import scratch_path

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


_NESTED_SCHEMA = T.StructType([*RAW_WORKOUT.fields, T.StructField("user_id", T.StringType())])


class Tables:
    """Lazy access to the Parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def landed(self, name: str) -> str:
        """Path of a view written as Parquet for this query."""
        path = self.scratch(name)
        getattr(self, name)().write.parquet(path)
        return path

    def landed_nested(self) -> DataFrame:
        """The nested workouts as an ingest would have stored them."""
        return self.spark.read.schema(_NESTED_SCHEMA).parquet(self.landed("nested"))

    def sets(self) -> DataFrame:
        """Order lines as workout sets; the customer is the user, the part the exercise."""
        line, order, part = self.lineitem, self.orders, self.part
        joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(
            part, line["l_partkey"] == part["p_partkey"]
        )
        return joined.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").alias("id"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderdate").alias("start_time"),
            F.col("l_shipdate").alias("end_time"),
            F.col("p_name").alias("exercise_title"),
            F.col("l_linenumber").alias("set_index"),
            F.col("l_returnflag").alias("set_type"),
            F.floor("l_extendedprice").cast("double").alias("weight_kg"),
            F.col("l_quantity").alias("reps"),
            F.col("l_discount").alias("rpe"),
            F.col("p_type").alias("muscle_group"),
        )

    def flat_sets(self) -> DataFrame:
        """Sets in the columns and types of the flat CSV feed."""
        stamp = "d MMM yyyy, HH:mm"
        sets = self.sets().withColumns(
            {
                "start_time": F.date_format("start_time", stamp),
                "end_time": F.date_format("end_time", stamp),
                "distance_km": F.when(F.col("set_type") == "A", F.col("reps")),
            }
        )
        cols = []
        for f in WORKOUT_CSV.fields:
            value = F.col(f.name) if f.name in sets.columns else F.lit(None)
            cols.append(value.cast(f.dataType).alias(f.name))
        return sets.select(*cols)

    def workouts(self) -> DataFrame:
        """Events as daily workouts, with NULL dates, muscle groups and sets."""
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        sets = F.floor("value").cast("int")
        return self.events.select(
            F.col("event_id").alias("workout_id"),
            "user_id",
            F.when((F.col("event_type") == "signup") & (F.col("value") < 5), None)
            .otherwise(F.col("ts"))
            .alias("date"),
            F.nullif(F.col("event_type"), F.lit("error")).alias("muscle_group"),
            F.concat(F.lit("exercise "), k.cast("string")).alias("exercise_name"),
            F.when(F.col("value") <= 200, sets).alias("total_sets"),
            k.alias("total_reps"),
            (k + 20).alias("duration_min"),
            (sets / 2).alias("weight_kg"),
            F.when(F.col("event_type") != "view", k / 4).alias("rpe"),
        )

    def nested(self) -> DataFrame:
        """Orders as nested workouts with one to three exercises of one to three sets."""
        stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
        exercises = """
            CASE WHEN o_orderpriority <> '5-LOW' THEN transform(
              filter(sequence(0, 2), i -> i <= instr('OFP', o_orderstatus) - 1),
              i -> named_struct(
                'title', concat('exercise ', o_custkey + i),
                'notes', o_orderpriority,
                'superset_id', i,
                'sets', transform(
                  filter(sequence(0, 2), j -> j <= i),
                  j -> named_struct(
                    'index', j,
                    'type', CASE WHEN j = 0 THEN 'warmup' ELSE 'normal' END,
                    'weight_kg', CAST(o_custkey + 2 * i + j AS DOUBLE),
                    'reps', CAST(5 + j AS DOUBLE),
                    'distance_meters', CASE WHEN i = 2 THEN CAST(o_custkey AS DOUBLE) END,
                    'duration_seconds', CAST(30 * (j + 1) AS DOUBLE),
                    'rpe', CAST(j AS DOUBLE))))) END"""
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderpriority").alias("title"),
            F.lit(None).cast("string").alias("description"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderstatus").alias("routine_id"),
            F.date_format("o_orderdate", stamp).alias("start_time"),
            F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 45 MINUTES"), stamp).alias("end_time"),
            F.date_format("o_orderdate", stamp).alias("created_at"),
            F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), stamp).alias("updated_at"),
            F.expr(exercises).alias("exercises"),
        )

    def catalog(self) -> DataFrame:
        """Parts as exercise catalogue; a name occurs with many muscles and equipments."""
        return self.part.select(
            F.col("p_name").alias("Exercise Name"),
            F.col("p_type").alias("Main_muscle"),
            F.col("p_brand").alias("Equipment"),
        )

    def mapping(self) -> DataFrame:
        """Title pairs: blue things have none, small ones no name, most titles two keys."""
        names = self.part.filter(~F.col("p_name").startswith("blue"))
        keys = names.groupBy("p_name").agg(
            F.array_distinct(F.array(F.min("p_partkey"), F.max("p_partkey"))).alias("keys")
        )
        return keys.select(
            F.explode("keys").alias("sk_exercise"),
            F.col("p_name").alias("exercise_title_heavy"),
            F.when(~F.col("p_name").startswith("small"), F.col("p_name")).alias("exercise_name_kaggle"),
        )

    def accounts(self) -> DataFrame:
        """Customers as accounts."""
        return self.customer.select(
            F.col("c_custkey").cast("string").alias("user_id"),
            F.col("c_name").alias("nome"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.lit("2024-01-01").alias("created_at"),
            F.col("c_mktsegment").alias("objetivo"),
            F.col("c_acctbal").alias("peso"),
        )

    def changes(self) -> DataFrame:
        """Events as profile changes; each kind of event sets other fields."""
        fields = (
            F.when(F.col("event_type") == "click", F.array(F.lit("peso")))
            .when(F.col("event_type") == "view", F.array(F.lit("objetivo")))
            .otherwise(F.array(F.lit("peso"), F.lit("objetivo")))
        )
        return self.events.select(
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").alias("updated_at"),
            F.col("event_type").alias("objetivo"),
            F.when(F.col("value") < 300, F.col("value")).alias("peso"),
            fields.alias("changed"),
        )


# SQL twins of the views above.
CTE = {
    "sets": """sets AS (
        SELECT o_custkey AS user_id, l_orderkey AS id, o_orderpriority AS title,
          o_orderdate AS start_time, l_shipdate AS end_time, p_name AS exercise_title,
          l_linenumber AS set_index, l_returnflag AS set_type,
          floor(l_extendedprice) AS weight_kg, l_quantity AS reps, l_discount AS rpe,
          p_type AS muscle_group
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey)""",
    "workouts": """events_k AS (
        SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
      workouts AS (
        SELECT event_id AS workout_id, user_id,
          CASE WHEN event_type = 'signup' AND value < 5 THEN NULL ELSE ts END AS date,
          nullif(event_type, 'error') AS muscle_group,
          'exercise ' || CAST(k AS VARCHAR) AS exercise_name,
          CASE WHEN value <= 200 THEN CAST(floor(value) AS INTEGER) END AS total_sets,
          k AS total_reps, k + 20 AS duration_min,
          floor(value) / 2 AS weight_kg, CASE WHEN event_type <> 'view' THEN k / 4 END AS rpe
        FROM events_k)""",
    "nested": """nested AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title,
          CAST(NULL AS VARCHAR) AS description, CAST(o_custkey AS VARCHAR) AS user_id,
          o_orderstatus AS routine_id, o_orderdate AS start_time,
          o_orderdate + INTERVAL 45 MINUTE AS end_time,
          strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
          strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
          'exercise ' || CAST(o_custkey + i AS VARCHAR) AS exercise_title,
          CAST(i AS INTEGER) AS superset_id, o_orderpriority AS exercise_notes,
          CAST(j AS INTEGER) AS set_index,
          CASE WHEN j = 0 THEN 'warmup' ELSE 'normal' END AS set_type,
          CAST(o_custkey + 2 * i + j AS DOUBLE) AS weight_kg, CAST(5 + j AS DOUBLE) AS reps,
          CASE WHEN i = 2 THEN CAST(o_custkey AS DOUBLE) / 1000 END AS distance_km,
          CAST(30 * (j + 1) AS DOUBLE) AS duration_seconds, CAST(j AS DOUBLE) AS rpe
        FROM orders, range(0, 3) a(i), range(0, 3) b(j)
        WHERE o_orderpriority <> '5-LOW' AND i < instr('OFP', o_orderstatus) AND j <= i)""",
    "catalog": """catalog AS (
        SELECT p_name, p_type AS main_muscle, p_brand AS equipment FROM part)""",
    "mapping": """mapping AS (
        SELECT DISTINCT unnest([lo, hi]) AS sk_exercise, p_name AS exercise_title_heavy,
          CASE WHEN NOT starts_with(p_name, 'small') THEN p_name END AS exercise_name_kaggle
        FROM (SELECT p_name, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part
          WHERE NOT starts_with(p_name, 'blue') GROUP BY p_name))""",
    "accounts": """accounts AS (
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS nome,
          lower(c_name) || '@example.com' AS email, '2024-01-01' AS created_at,
          c_mktsegment AS objetivo, c_acctbal AS peso FROM customer)""",
    "changes": """changes AS (
        SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS updated_at,
          event_type AS objetivo, CASE WHEN value < 300 THEN value END AS peso,
          event_type <> 'view' AS sets_peso, event_type <> 'click' AS sets_objetivo
        FROM events)""",
}


def spelled(ts: str, kind: str) -> Column:
    """A time as text: rows whose ``kind`` is "click" say it in a zone three hours ahead."""
    ahead = F.date_format(F.col(ts) + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+03:00'")
    return F.when(F.col(kind) == "click", ahead).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def with_views(names: str, body: str) -> str:
    """``body`` with the named SQL views in front."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
