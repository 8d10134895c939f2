"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables, with_views
from trainlake.operators import joins as jn
from trainlake.operators.shape import rename
from trainlake.schemas import CATALOG_RENAMES


@query(
    with_views(
        "sets mapping",
        """SELECT user_id, id, set_index, weight_kg, exercise_title, exercise_name_kaggle, sk_exercise
        FROM sets LEFT JOIN mapping ON exercise_title = exercise_title_heavy""",
    )
)
def mapped_sets(t: Tables) -> DataFrame:
    sets = t.sets().select("user_id", "id", "set_index", "weight_kg", "exercise_title")
    return jn.join_mapping(sets, t.mapping())


@query(
    with_views(
        "catalog sets",
        """, dim AS (SELECT * FROM catalog
          QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY main_muscle, equipment) = 1)
        SELECT id, set_index, weight_kg, exercise_name_kaggle, main_muscle, equipment
        FROM (SELECT *, nullif(exercise_title, 'red ring') AS exercise_name_kaggle FROM sets)
        LEFT JOIN dim ON exercise_name_kaggle = p_name""",
    )
)
def enriched_sets(t: Tables) -> DataFrame:
    sets = t.sets().select(
        "id",
        "set_index",
        "weight_kg",
        F.nullif(F.col("exercise_title"), F.lit("red ring")).alias("exercise_name_kaggle"),
    )
    return jn.enrich_muscles(sets, rename(t.catalog(), CATALOG_RENAMES))


@query(
    with_views(
        "mapping catalog",
        """SELECT sk_exercise, exercise_title_heavy, exercise_name_kaggle,
          main_muscle AS "Main_muscle", equipment AS "Equipment"
        FROM mapping LEFT JOIN (SELECT DISTINCT * FROM catalog) ON exercise_name_kaggle = p_name""",
    )
)
def dim_exercise(t: Tables) -> DataFrame:
    return jn.build_dim_exercise(t.mapping(), t.catalog())


@query(
    """WITH m AS (SELECT DISTINCT l_partkey, l_returnflag AS muscle FROM lineitem),
    i AS (SELECT DISTINCT l_partkey, l_linenumber AS step_number, l_linestatus AS instruction
      FROM lineitem)
    SELECT CAST(p_partkey AS VARCHAR) AS exercise_id, p_name AS exercise_name, p_brand AS equipment,
      p_type AS main_muscle, muscle, step_number, instruction
    FROM part LEFT JOIN m ON p_partkey = m.l_partkey LEFT JOIN i ON p_partkey = i.l_partkey"""
)
def gold_view(t: Tables) -> DataFrame:
    key = F.col("l_partkey").cast("string").alias("exercise_id")
    exercises = t.part.select(
        F.col("p_partkey").cast("string").alias("exercise_id"),
        F.col("p_name").alias("exercise_name"),
        F.col("p_brand").alias("equipment"),
        F.col("p_type").alias("main_muscle"),
    )
    muscles = t.lineitem.select(key, F.col("l_returnflag").alias("muscle"))
    steps = t.lineitem.select(
        key, F.col("l_linenumber").alias("step_number"), F.col("l_linestatus").alias("instruction")
    )
    return jn.gold_view(exercises, muscles.distinct(), steps.distinct())


@query(
    """SELECT count(DISTINCT u) AS keys_a, count(DISTINCT c) AS keys_b,
      count(DISTINCT CASE WHEN u IS NOT NULL THEN c END) AS in_both,
      count(DISTINCT CASE WHEN u IS NULL THEN c END) AS only_b
    FROM (SELECT user_id AS u FROM events) FULL JOIN (SELECT c_custkey AS c FROM customer) ON u = c"""
)
def key_overlap(t: Tables) -> DataFrame:
    events = t.events.select(F.col("user_id").alias("key"))
    customers = t.customer.select(F.col("c_custkey").alias("key"))
    return jn.key_overlap(events, customers, "key")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(t: Tables) -> DataFrame:
    return jn.orphans(t.documents, t.labels, "doc_id")


_LAST_CHANGE = """, last_peso AS (SELECT user_id, peso FROM changes WHERE sets_peso
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1),
    last_objetivo AS (SELECT user_id, objetivo FROM changes WHERE sets_objetivo
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1)
    SELECT a.user_id, a.nome, a.email, a.created_at,
      CASE WHEN o.user_id IS NOT NULL THEN o.objetivo ELSE a.objetivo END AS objetivo,
      CASE WHEN p.user_id IS NOT NULL THEN p.peso ELSE a.peso END AS peso
    FROM accounts a LEFT JOIN last_peso p ON a.user_id = p.user_id
    LEFT JOIN last_objetivo o ON a.user_id = o.user_id"""


@query(with_views("accounts changes", _LAST_CHANGE))
def upsert_profiles(t: Tables) -> DataFrame:
    return jn.upsert_profiles(t.accounts(), t.changes(), changed_fields="changed")


@query(
    with_views(
        "accounts",
        """, asked AS (
          SELECT lower(s_name) || '@example.com' AS email, s_name AS nome FROM supplier
          UNION SELECT lower(c_name) || '@example.com', c_name FROM customer),
        fresh AS (SELECT *, md5(email) AS h FROM asked WHERE email NOT IN (SELECT email FROM accounts))
        SELECT * FROM accounts
        UNION ALL SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
          || substr(h, 17, 4) || '-' || substr(h, 21, 12), nome, email, '2024-06-15', NULL, NULL FROM fresh""",
    )
)
def insert_new_accounts(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(
        F.concat(F.upper("s_name"), F.lit("@EXAMPLE.com ")).alias("email"), F.col("s_name").alias("nome")
    )
    customers = t.customer.select(
        F.concat(F.lit(" "), F.col("c_name"), F.lit("@example.com")).alias("email"), F.col("c_name").alias("nome")
    )
    nameless = t.nation.select(F.lit("x@example.com").alias("email"), F.lit(" ").alias("nome"))
    asked = suppliers.unionAll(suppliers).unionAll(customers).unionAll(nameless)
    return jn.insert_new_accounts(t.accounts(), asked, created_at=F.lit("2024-06-15"))


@query(
    with_views(
        "changes",
        """SELECT user_id, updated_at, objetivo, peso FROM changes
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1""",
    )
)
def latest_profiles(t: Tables) -> DataFrame:
    return jn.latest_profiles(t.changes().drop("changed"))


@query(
    with_views(
        "accounts changes",
        """, last AS (SELECT * FROM changes
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1)
        SELECT a.user_id, a.nome, a.created_at,
          CASE WHEN l.objetivo = 'click' THEN 'new@example.com' ELSE a.email END AS email,
          CASE WHEN l.user_id IS NOT NULL THEN l.objetivo ELSE a.objetivo END AS objetivo,
          CASE WHEN l.user_id IS NOT NULL THEN l.peso ELSE a.peso END AS peso
        FROM accounts a LEFT JOIN last l ON a.user_id = l.user_id""",
    )
)
def overlay(t: Tables) -> DataFrame:
    current = jn.latest_profiles(t.changes().drop("changed")).drop("updated_at")
    email = F.when(F.col("objetivo") == "click", F.lit("new@example.com")).otherwise(F.lit(""))
    return jn.overlay(t.accounts(), current.withColumn("email", email))
