"""Whole jobs: silver, gold, dashboard, context and incremental loads."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.metric_checks import KPI_SQL, LAST_SQL, SUMMARY_SQL, top_sql
from checkset.registry import query, rounded
from checkset.source_checks import FLAT_SQL, METRICS_SQL, write_csv
from checkset.tables import Tables, spelled, with_views
from checkset.value_checks import as_of
from trainlake.plans import context, csv_etl, dashboard, gold, incremental, silver, star
from trainlake.plans import profiles as profiles_job
from trainlake.plans.lake import Lake
from trainlake.sources.buckets import read_buckets
from trainlake.sources.commits import commit_rows, compact, live_commits, read_commits, read_committed, vacuum
from trainlake.sources.readers import read_appended, read_latest_snapshot, read_table
from trainlake.sources.writers import append_batch, write_snapshot, write_table
from trainlake.streaming.batch import ingest_incremental, ingest_new_files
from trainlake.streaming.stream import stream_workouts

DAY = date(2024, 6, 15)
NEXT_DAY = date(2024, 6, 16)



def silver_sql(user: str) -> str:
    """Every silver column of base sets and of the nested workouts, whose user is ``user``."""
    return f"""SELECT CAST(user_id AS VARCHAR) AS user_id, * EXCLUDE (user_id) FROM (
      SELECT CAST(user_id AS VARCHAR) AS user_id, title, start_time, end_time, CAST(NULL AS VARCHAR) AS description,
        exercise_title, CAST(NULL AS INTEGER) AS superset_id, CAST(NULL AS VARCHAR) AS exercise_notes,
        set_index, set_type, weight_kg, reps, CASE WHEN set_type = 'A' THEN CAST(reps AS DOUBLE) END AS distance_km,
        CAST(NULL AS DOUBLE) AS duration_seconds, rpe, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS routine_id,
        CAST(NULL AS VARCHAR) AS updated_at, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS id_exercice,
        date_diff('microsecond', start_time, end_time) / 60000000 AS duracao FROM sets
      UNION ALL SELECT {user}, title, start_time, end_time, description, exercise_title, superset_id, exercise_notes,
        set_index, set_type, weight_kg, reps, distance_km, duration_seconds, rpe, id, routine_id, updated_at, created_at,
        id, CAST(45 AS DOUBLE) FROM nested)"""


@query(with_views("sets nested", silver_sql("'api-user'")))
def silver_workouts(t: Tables) -> DataFrame:
    base = read_table(t.spark, t.landed("flat_sets"))
    sets = silver.build_silver_workouts(base, t.landed_nested(), "api-user")
    path = t.scratch("silver")
    write_table(sets, path)
    return read_table(t.spark, path)


@query(
    with_views(
        "sets nested",
        f"SELECT *, CAST(date_trunc('month', start_time) AS DATE) AS start_month FROM ({silver_sql('user_id')})",
    ),
    dates=["start_month"],
)
def silver_workouts_job(t: Tables) -> DataFrame:
    """The job over a bronze of many users: two delivered days, the second one as an increment."""
    lake = Lake(t.scratch("lake"))
    write_table(t.flat_sets(), lake.bronze("workouts_base"))
    nested = t.landed_nested()
    append_batch(nested.filter("routine_id <> 'O'"), lake.bronze("workouts"), DAY)
    silver.run_silver_workouts(t.spark, lake)
    append_batch(nested.filter("routine_id = 'O'"), lake.bronze("workouts"), NEXT_DAY)
    silver.run_silver_workouts(t.spark, lake)
    return silver.read_silver_workouts(t.spark, lake)


@query(
    with_views(
        "nested",
        """, loads AS (SELECT *, CASE WHEN routine_id = 'F' THEN '2024-06-20T00:00:00Z' ELSE updated_at END AS changed FROM nested)
        SELECT id, exercise_title, set_index, weight_kg, changed AS updated_at FROM loads""",
    )
)
def silver_increment_twice(t: Tables) -> DataFrame:
    """Two batches of one day, a run after each, one more without news, and a batch that delivers
    some workouts again under an earlier day: no set is lost, none counts twice."""
    lake = Lake(t.scratch("lake"))
    write_table(t.flat_sets().limit(0), lake.bronze("workouts_base"))
    nested = t.landed_nested()
    append_batch(nested.filter("routine_id = 'O'"), lake.bronze("workouts"), NEXT_DAY)
    silver.run_silver_workouts(t.spark, lake)
    append_batch(nested.filter("routine_id <> 'O'"), lake.bronze("workouts"), NEXT_DAY)
    silver.run_silver_workouts(t.spark, lake)
    silver.run_silver_workouts(t.spark, lake)
    again = nested.filter("routine_id = 'F'").withColumn("updated_at", F.lit("2024-06-20T00:00:00Z"))
    append_batch(again, lake.bronze("workouts"), DAY)
    silver.run_silver_workouts(t.spark, lake)
    sets = silver.read_silver_workouts(t.spark, lake, newest_only=True)
    return sets.select("id", "exercise_title", "set_index", "weight_kg", "updated_at")


@query(
    """SELECT DISTINCT o_custkey AS user_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS data_nascimento,
      o_orderpriority AS nivel_treinamento FROM orders"""
)
def silver_users(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.lit("?"))
    )
    form = t.orders.select(
        F.col("o_custkey").alias("User Id"),
        text.alias("Data Nascimento"),
        F.col("o_orderpriority").alias("Nivel Treinamento"),
    )
    # Spellings of one date become equal after parsing, and so do their rows.
    return silver.build_silver_users(form)


@query(
    """SELECT p_partkey, p_name AS "Exercise Name", p_type || ' ' || p_brand AS "Execution",
      p_retailprice FROM part"""
)
def silver_catalog(t: Tables) -> DataFrame:
    raw = t.part.select(
        "p_partkey",
        F.concat(F.lit(" \\u200b"), F.col("p_name"), F.lit("\n")).alias("Exercise Name"),
        F.concat(F.col("p_type"), F.lit("\r"), F.col("p_brand"), F.lit("\u200b ")).alias("Execution"),
        "p_retailprice",
    )
    return silver.build_silver_catalog(raw)


@query(
    """SELECT DISTINCT l_partkey AS sk_exercise, l_returnflag AS exercise_title_heavy,
      l_linestatus AS exercise_name_kaggle, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS score
    FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity >= 5"""
)
def silver_mapping(t: Tables) -> DataFrame:
    score = F.when(F.col("l_returnflag") == "N", F.lit("abc")).otherwise(F.col("l_quantity").cast("string"))
    raw = t.lineitem.select(
        F.col("l_partkey").alias(" SK Exercise"),
        F.col("l_returnflag").alias("Exercise Title Hevy"),
        F.col("l_linestatus").alias("exercise_kaggle "),
        score.alias("Score"),
    )
    return silver.build_silver_mapping(raw)


@query(
    """SELECT p_name AS title, lower(p_type) AS type, lower(p_brand) AS equipment,
      replace(p_name, ' ', '|') AS primary_muscles, replace(p_name, ' ', '_') AS exercise_id
    FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY lower(p_brand), lower(p_type)) = 1"""
)
def silver_gym(t: Tables) -> DataFrame:
    listed = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', '")), F.lit("']"))
    raw = t.part.select(
        F.col("p_name").alias("Title"),
        F.concat(F.lit(" "), F.col("p_brand")).alias("Equipment"),
        F.col("p_type").alias("Type"),
        listed.alias("Primary-Muscles"),
    )
    gym = silver.build_silver_gym(raw, as_of()).drop("ingestion_date")
    return gym.withColumn("primary_muscles", F.array_join("primary_muscles", "|"))


@query(
    """WITH forms AS (
      SELECT CAST(user_id AS VARCHAR) AS user_id, value AS peso, CAST(1.8 AS DOUBLE) AS altura,
        CASE WHEN event_type = 'error' AND value > 100 THEN NULL ELSE ts END AS data_registro,
        event_type AS nivel_treinamento FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY data_registro DESC NULLS FIRST, value DESC) = 1),
    measured AS (SELECT *, peso / (altura * altura) AS imc FROM forms)
    SELECT *, CASE WHEN imc < 18.5 THEN 'baixo_peso' WHEN imc < 25 THEN 'normal' WHEN imc < 30 THEN 'sobrepeso'
      ELSE 'obesidade' END AS faixa_imc FROM measured"""
)
def silver_profiles(t: Tables) -> DataFrame:
    missing = (F.col("event_type") == "error") & (F.col("value") > 100)
    raw = t.events.select(
        F.col("user_id").cast("string").alias("User-Id"),
        F.when(~missing, F.col("ts")).alias("data_registro"),
        F.col("value").cast("string").alias("Peso"),
        F.lit("1.8").alias("Altura"),
        F.concat(F.lit(" "), F.upper("event_type")).alias("nível_treinamento"),
    )
    return silver.build_silver_profiles(raw, as_of(), as_of()).drop("silver_ingestion_ts_utc")


_FACT_SQL = """, dim AS (SELECT * FROM catalog
      QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY main_muscle, equipment) = 1)
    SELECT CAST(user_id AS VARCHAR) AS user_id, sk_exercise, id, title, start_time, end_time, exercise_title,
      set_index, set_type, weight_kg, reps, rpe, dim.main_muscle, dim.equipment, exercise_name_kaggle, muscle_group
    FROM sets LEFT JOIN mapping ON exercise_title = exercise_title_heavy
    LEFT JOIN dim ON exercise_name_kaggle = dim.p_name"""


@query(with_views("sets catalog mapping", _FACT_SQL))
def fact_sets(t: Tables) -> DataFrame:
    return gold.build_fact_sets(t.sets(), t.mapping(), t.catalog())


@query(
    with_views(
        "sets catalog mapping",
        f"""SELECT *, CAST(date_trunc('month', start_time) AS DATE) AS start_month
        FROM (WITH one AS (SELECT 1) {_FACT_SQL})""",
    ),
    dates=["start_month"],
)
def fact_job(t: Tables) -> DataFrame:
    lake = Lake(t.scratch("lake"))
    sets = read_table(t.spark, t.landed("sets"))
    gold.write_fact_sets(gold.build_fact_sets(sets, t.mapping(), t.catalog()), lake)
    return read_table(t.spark, lake.gold("fact_train"))


@query(with_views("sets catalog mapping", _FACT_SQL))
def mapping_to_fact(t: Tables) -> DataFrame:
    """The fact by way of the silver mapping, whose source has the columns' other names."""
    names = {"sk_exercise": " SK Exercise", "exercise_title_heavy": "Exercise Title Hevy", "exercise_name_kaggle": "exercise_kaggle "}
    mapping = silver.build_silver_mapping(t.mapping().withColumnsRenamed(names))
    return gold.build_fact_sets(t.sets(), mapping, t.catalog())


@query(
    """SELECT row_number() OVER (ORDER BY exercise_name_kaggle, main_muscle, equipment) AS sk_exercise_kaggle, *
    FROM (SELECT DISTINCT p_name AS exercise_name_kaggle, p_type AS main_muscle, p_brand AS equipment FROM part)"""
)
def dim_catalog(t: Tables) -> DataFrame:
    return gold.build_dim_catalog(t.catalog())


@query(
    with_views(
        "accounts sets",
        """SELECT 'users' AS kind, user_id AS key, email AS value FROM accounts
        UNION ALL SELECT 'workouts', id || '/' || set_index, exercise_title FROM sets
        UNION ALL SELECT 'exercises', p_name, p_type || ' ' || p_brand FROM part""",
    )
)
def gold_snapshots(t: Tables) -> DataFrame:
    lake = Lake(t.scratch("lake"))
    exercises = t.catalog().withColumnRenamed("Exercise Name", "title")
    gold.promote_gold(lake, DAY, t.accounts(), t.sets(), exercises)
    gold.promote_gold(lake, DAY, t.accounts(), t.sets(), t.catalog())
    users, workouts, exercises = (
        read_latest_snapshot(t.spark, lake.gold(name)) for name in ("dim_users", "fact_workouts", "dim_exercises")
    )
    shown = [
        users.select(F.lit("users").alias("kind"), F.col("user_id").alias("key"), F.col("email").alias("value")),
        workouts.select(F.lit("workouts"), F.concat_ws("/", F.col("id").cast("string"), F.col("set_index").cast("string")), "exercise_title"),
        exercises.select(F.lit("exercises"), "title", F.concat_ws(" ", "Main_muscle", "Equipment")),
    ]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


@query(with_views("sets", METRICS_SQL))
def gold_metrics(t: Tables) -> DataFrame:
    return gold.build_metrics(t.sets())


_RENAMED_SQL = f"SELECT * RENAME (title AS workout_title, exercise_title AS exercise_name) FROM ({FLAT_SQL})"


@query(with_views("sets", _RENAMED_SQL))
def csv_job(t: Tables) -> DataFrame:
    src = write_csv(t.flat_sets(), t.scratch("feed"))
    paths = csv_etl.csv_etl(t.spark, src, t.scratch("lake"), DAY)
    return read_table(t.spark, paths["silver"])


@query(with_views("sets", _RENAMED_SQL))
def csv_feed_job(t: Tables) -> DataFrame:
    """Three deliveries of CSV files in one folder, with a run after each and one more."""
    src, base = t.scratch("feed"), t.scratch("lake")
    for k, kind in enumerate("ANR"):
        write_csv(t.flat_sets().filter(f"set_type = '{kind}'"), f"{src}/delivery{k}")
        csv_etl.csv_feed(t.spark, src, base)
    csv_etl.csv_feed(t.spark, src, base)
    return read_committed(t.spark, f"{base}/silver/workouts_feed")


# Each dashboard table as rows of the same columns: its name, the user, a key and a number.
_SHOWN = {
    "kpis": ("concat_ws('/', workouts, days)", "avg_total_sets"),
    "weekly": ("year_week", "workouts"),
    "daily": ("CAST(day AS STRING)", "rolling_7d"),
    "muscle_share": ("muscle_group", "percent"),
    "dow_muscle": ("concat_ws('/', dow_index, muscle_group)", "total_sets"),
    "exercise_ranking": ("concat_ws('/', position, exercise_name)", "total_sets"),
    "duration_volume": ("CAST(total_sets AS STRING)", "duration_min"),
    "detail": ("concat_ws('/', year_week, exercise_name)", "weight_kg"),
}
_DASHBOARD_SQL = f""", dated AS (SELECT * FROM workouts WHERE date IS NOT NULL),
    daily AS (SELECT user_id, CAST(date AS DATE) AS day, coalesce(sum(total_sets), 0) AS sets FROM dated GROUP BY 1, 2),
    share AS (SELECT user_id, muscle_group, coalesce(sum(total_sets), 0) AS v FROM dated
      WHERE muscle_group IS NOT NULL GROUP BY 1, 2),
    ranking AS (SELECT user_id, exercise_name, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, exercise_name) AS position
      FROM (SELECT user_id, exercise_name, coalesce(sum(total_sets), 0) AS v FROM dated
        WHERE exercise_name IS NOT NULL GROUP BY 1, 2) QUALIFY position <= 10)
    SELECT 'kpis' AS table_name, user_id, workouts || '/' || days AS key, avg_total_sets AS value FROM ({KPI_SQL})
    UNION ALL SELECT 'weekly', user_id, strftime(date, '%Y-%U'), CAST(count(*) AS DOUBLE) FROM dated GROUP BY 2, 3
    UNION ALL SELECT 'daily', user_id, CAST(day AS VARCHAR), CAST(sum(sets) OVER last AS DOUBLE) / count(*) OVER last FROM daily
      WINDOW last AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    UNION ALL SELECT 'muscle_share', user_id, muscle_group,
      100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY user_id) AS DOUBLE) FROM share
    UNION ALL SELECT 'dow_muscle', user_id, (isodow(date) - 1) || '/' || muscle_group, CAST(coalesce(sum(total_sets), 0) AS DOUBLE)
      FROM dated WHERE muscle_group IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'exercise_ranking', user_id, position || '/' || exercise_name, CAST(v AS DOUBLE) FROM ranking
    UNION ALL SELECT 'duration_volume', user_id, CAST(total_sets AS VARCHAR), CAST(duration_min AS DOUBLE) FROM dated
    UNION ALL SELECT 'detail', user_id, strftime(date, '%Y-%U') || '/' || exercise_name, CAST(weight_kg AS DOUBLE) FROM dated"""


@query(with_views("workouts", _DASHBOARD_SQL))
def dashboard_job(t: Tables) -> DataFrame:
    paths = dashboard.run_dashboard(t.spark, t.workouts(), t.scratch("dashboard"))
    if set(paths) != set(_SHOWN):
        raise ValueError(f"the dashboard has other tables: {sorted(paths)}")
    shown = [
        read_table(t.spark, paths[name]).select(
            F.lit(name).alias("table_name"), "user_id", F.expr(key).alias("key"), F.col(value).cast("double").alias("value")
        )
        for name, (key, value) in _SHOWN.items()
    ]
    return reduce(DataFrame.unionAll, shown)


def loaded_workouts(t: Tables, after_each) -> str:
    """Path of a committed table of the workouts that came in three loads, whose days overlap and of
    which the last one is the oldest; ``after_each`` runs after each load, and at the end again."""
    path, workouts = t.scratch("workouts"), t.workouts()
    late = "pmod(workout_id, 5) = 0 AND date < TIMESTAMP_NTZ '2024-02-01 00:00:00'"
    for part in (f"pmod(workout_id, 2) = 0 AND NOT coalesce({late}, false)", f"pmod(workout_id, 2) = 1 AND NOT coalesce({late}, false)", f"coalesce({late}, false)"):
        commit_rows(workouts.filter(part), path)
        after_each(path)
    after_each(path)
    return path


@query(with_views("workouts", KPI_SQL), dates=["last_date"])
def kpis_incremental(t: Tables) -> DataFrame:
    base = t.scratch("gold")
    src = loaded_workouts(t, lambda path: incremental.update_kpis(t.spark, path, base))
    return incremental.update_kpis(t.spark, src, base)


@query(with_views("workouts", SUMMARY_SQL))
def summary_incremental(t: Tables) -> DataFrame:
    """The state is compacted between the loads, and so is the source."""
    base = t.scratch("gold")

    def after_each(path: str) -> None:
        incremental.update_summaries(t.spark, path, base)
        incremental.compact_state(t.spark, f"{base}/history_state", ("user_id", "week"))
        compact(t.spark, path)

    return incremental.update_summaries(t.spark, loaded_workouts(t, after_each), base)


_ROLLUP_TABLES = ("kpis", "weekly", "daily", "muscle_share", "dow_muscle")


@query(with_views("workouts", f"SELECT * FROM (WITH one AS (SELECT 1) {_DASHBOARD_SQL}) WHERE table_name IN {_ROLLUP_TABLES}"))
def dashboard_incremental(t: Tables) -> DataFrame:
    base = t.scratch("dashboard")
    src = loaded_workouts(t, lambda path: incremental.update_dashboard(t.spark, path, base))
    paths = incremental.update_dashboard(t.spark, src, base)
    shown = [
        read_table(t.spark, paths[name]).select(
            F.lit(name).alias("table_name"), "user_id", F.expr(key).alias("key"), F.col(value).cast("double").alias("value")
        )
        for name, (key, value) in _SHOWN.items()
        if name in _ROLLUP_TABLES
    ]
    return reduce(DataFrame.unionAll, shown)


@query(
    with_views(
        "workouts",
        f"""SELECT user_id, count(*) AS workouts,
          {rounded('CAST(sum(total_reps) AS DOUBLE) / count(total_reps)', 1)} AS avg_total_reps,
          {rounded('CAST(sum(duration_min) AS DOUBLE) / count(duration_min)', 1)} AS avg_duration_min
        FROM workouts GROUP BY user_id""",
    )
)
def dashboard_sparse(t: Tables) -> DataFrame:
    """Workouts without date, muscle group, sets and intensity: what can be shown is."""
    sparse = t.workouts().select("workout_id", "user_id", "total_reps", "duration_min")
    paths = dashboard.run_dashboard(t.spark, sparse, t.scratch("dashboard"))
    if set(paths) != {"kpis", "detail"}:
        raise ValueError(f"the sparse dashboard has other tables: {sorted(paths)}")
    return read_table(t.spark, paths["kpis"])


_NUMBER = "regexp_replace(CAST(CAST({} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"
_LINES = (
    ("- Total de séries (soma): ", "total_sets"),
    ("- Total de repetições (soma): ", "total_reps"),
    ("- Carga média registrada: ", "avg_weight"),
    ("- Intensidade média (RPE/RIR/etc): ", "avg_rpe_or_intensity"),
)
_TEXT_SQL = f""", summary AS ({SUMMARY_SQL}), ex AS ({top_sql('exercise_name')}),
    mu AS ({top_sql('muscle_group')}), recent AS ({LAST_SQL}),
    ex_line AS (SELECT user_id, string_agg(value || ' (' || n || 'x)', ', ' ORDER BY position) AS line
      FROM ex WHERE position <= 6 GROUP BY user_id),
    mu_line AS (SELECT user_id, string_agg(value || ' (' || n || 'x)', ', ' ORDER BY position) AS line
      FROM mu WHERE position <= 6 GROUP BY user_id),
    last_lines AS (SELECT user_id, string_agg('  • ' || concat_ws(' | ', date, exercise_name,
        'sets=' || total_sets, 'reps=' || total_reps, 'carga=' || weight_kg, 'musculo=' || muscle_group,
        'int=' || rpe), chr(10) ORDER BY position) AS line
      FROM (SELECT *, max(position) OVER (PARTITION BY user_id) AS top FROM recent)
      WHERE position > top - 5 GROUP BY user_id),
    history AS (SELECT s.user_id, concat_ws(chr(10), 'Histórico real de treinos (GOLD fact_train):',
      '- Período: ' || strftime(first_date, '%Y-%m-%d') || ' até ' || strftime(last_date, '%Y-%m-%d'),
      '- Dias com treino: ' || unique_days || ' | Semanas com registro: ' || weeks,
      {', '.join(f"'{label}' || " + _NUMBER.format(name) for label, name in _LINES)},
      '- Exercícios mais frequentes: ' || ex_line.line,
      '- Grupos musculares mais treinados: ' || mu_line.line,
      '- Últimos registros (amostra):' || chr(10) || last_lines.line) AS summary
    FROM summary s LEFT JOIN ex_line USING (user_id) LEFT JOIN mu_line USING (user_id)
    LEFT JOIN last_lines USING (user_id))"""


@query(with_views("workouts", _TEXT_SQL + " SELECT user_id, summary FROM history"))
def summary_text(t: Tables) -> DataFrame:
    return context.build_summaries(t.workouts(), tie_break=["workout_id"])


_UNDATED_SQL = f""", ex AS ({top_sql('exercise_name', dated=False)}), mu AS ({top_sql('muscle_group', dated=False)}),
    summary AS (SELECT user_id, CAST(sum(total_sets) AS DOUBLE) AS total_sets, CAST(sum(total_reps) AS DOUBLE) AS total_reps,
      {rounded('CAST(sum(weight_kg) AS DOUBLE) / count(weight_kg)', 2)} AS avg_weight,
      {rounded('CAST(sum(rpe) AS DOUBLE) / count(rpe)', 2)} AS avg_rpe_or_intensity FROM workouts GROUP BY user_id),
    ex_line AS (SELECT user_id, string_agg(value || ' (' || n || 'x)', ', ' ORDER BY position) AS line
      FROM ex WHERE position <= 6 GROUP BY user_id),
    mu_line AS (SELECT user_id, string_agg(value || ' (' || n || 'x)', ', ' ORDER BY position) AS line
      FROM mu WHERE position <= 6 GROUP BY user_id)
    SELECT s.user_id, concat_ws(chr(10), 'Histórico real de treinos (GOLD fact_train):',
      {', '.join(f"'{label}' || " + _NUMBER.format(name) for label, name in _LINES)},
      '- Exercícios mais frequentes: ' || ex_line.line, '- Grupos musculares mais treinados: ' || mu_line.line) AS summary
    FROM summary s LEFT JOIN ex_line USING (user_id) LEFT JOIN mu_line USING (user_id)"""


@query(with_views("workouts", _UNDATED_SQL))
def summary_without_date(t: Tables) -> DataFrame:
    return context.build_summaries(t.workouts().drop("date"))


_PROFILE_SQL = """SELECT c_custkey AS user_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10),
      'Perfil do aluno:', '- Nome: ' || c_name,
      '- Idade: ' || (2024 - (1950 + c_nationkey) - 1),
      '- Data de nascimento: ' || (1950 + c_nationkey) || '-07-01', '- Sexo: Não informado', '',
      'Composição corporal:',
      '- Peso (kg): ' || CASE WHEN c_nationkey = 0 THEN 'Não informado' ELSE CAST(c_nationkey AS VARCHAR) END,
      '- Altura: Não informada', '- % Gordura: 12', '', 'Objetivo e nível:', '- Objetivo: ' || c_mktsegment,
      '- Nível de treinamento/experiência: Não informado', '- Foco do programa: Não informado', '', 'Rotina:',
      '- Frequência semanal (dias/semana): Não informada', '- Minutos por treino: Não informado',
      '- Passos/dia: Não informado', '- Sono (horas/noite): Não informado', '- Estresse (1 a 5): Não informado',
      '', 'Preferências:', '- Tipo de treino principal: Não informado', '- Acesso a equipamentos: Não informado',
      '', 'Limitações e observações:', '- Dores/limitações articulares: Nenhuma informada',
      '- Restrições médicas: Nenhuma informada', '- Observações gerais: Nenhuma'), summary) AS context
    FROM customer LEFT JOIN history ON c_custkey = history.user_id"""


def profiles(t: Tables) -> DataFrame:
    """Customers as profiles with an empty and a second fat column."""
    return t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("nome"),
        F.concat((F.lit(1950) + F.col("c_nationkey")).cast("string"), F.lit("-07-01")).alias("data_nascimento"),
        F.col("c_nationkey").alias("peso"),
        F.col("c_mktsegment").alias("objetivo"),
        F.lit("").alias("gordura"),
        F.lit(12).alias("percentual_gordura"),
    )


@query(with_views("workouts", _TEXT_SQL + _PROFILE_SQL))
def profile_text(t: Tables) -> DataFrame:
    return context.build_context(profiles(t), t.workouts(), as_of(), tie_break=["workout_id"])


@query(
    """SELECT event_id, event_type AS user_id, CAST(dt AS INTEGER) AS dt FROM (
      SELECT *, 20240615 AS dt FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
      UNION ALL SELECT *, 20240616 FROM events WHERE ts > (SELECT max(ts) FROM events
        WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'))"""
)
def ingest_batches(t: Tables) -> DataFrame:
    state, dst = t.scratch("state"), t.scratch("bronze")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    feed = t.events.select("event_id", F.col("event_type").alias("user_id"), stamp.alias("updated_at"))
    early = feed.filter("CAST(updated_at AS TIMESTAMP) <= TIMESTAMP '2024-01-20 00:00:00'")
    ingest_incremental(t.spark, early, state, dst, DAY)
    ingest_incremental(t.spark, feed, state, dst, NEXT_DAY)
    ingest_incremental(t.spark, feed, state, dst, NEXT_DAY)
    return read_table(t.spark, dst).select("event_id", "user_id", "dt")


@query(
    with_views(
        "nested",
        """SELECT user_id, id, exercise_title, set_index, weight_kg, distance_km, duracao, start_month FROM (
          SELECT *, CAST(45 AS DOUBLE) AS duracao, CAST(date_trunc('month', start_time) AS DATE) AS start_month FROM nested)""",
    ),
    dates=["start_month"],
)
def stream_sets(t: Tables) -> DataFrame:
    src, dst, checkpoint = t.scratch("raw"), t.scratch("silver"), t.scratch("checkpoint")
    nested = t.landed_nested()
    write_table(nested.filter("routine_id = 'O'"), f"{src}/batch1")
    stream_workouts(t.spark, src, dst, checkpoint).awaitTermination()
    write_table(nested.filter("routine_id <> 'O'"), f"{src}/batch2")
    stream_workouts(t.spark, src, dst, checkpoint).awaitTermination()
    stream_workouts(t.spark, src, dst, checkpoint).awaitTermination()
    cols = "user_id id exercise_title set_index weight_kg distance_km duracao start_month".split()
    return read_committed(t.spark, dst).select(*cols)


@query(
    """SELECT event_id, event_type AS user_id, value, CASE WHEN event_type = 'view' THEN 'api' END AS source
    FROM events"""
)
def ledger_ingest(t: Tables) -> DataFrame:
    """Files that come late, under an earlier day, twice on one day, of one user's folder and with a
    new column; loads run after each delivery, two files to a commit, and each file counts once."""
    src, dst = t.scratch("feed"), t.scratch("bronze")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    feed = t.events.select("event_id", F.col("event_type").alias("user_id"), "value", stamp.alias("updated_at"))
    late = "CAST(updated_at AS TIMESTAMP) > TIMESTAMP '2024-01-20 00:00:00'"
    append_batch(feed.filter(f"user_id <> 'view' AND user_id <> 'click' AND {late}"), src, NEXT_DAY)
    ingest_new_files(t.spark, src, dst, max_files=2)
    append_batch(feed.filter(f"user_id <> 'view' AND user_id <> 'click' AND NOT {late}"), src, DAY)
    append_batch(feed.filter("user_id = 'view'").withColumn("source", F.lit("api")), src, NEXT_DAY)
    write_table(feed.filter("user_id = 'click'").drop("user_id"), f"{src}/user=click/dt=20240614")
    ingest_new_files(t.spark, src, dst, max_files=2)
    ingest_new_files(t.spark, src, dst)
    return read_committed(t.spark, dst).select("event_id", "user_id", "value", "source")


_STREAMED_SQL = """, dim AS (SELECT * FROM catalog
      QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY main_muscle, equipment) = 1)
    SELECT user_id, sk_exercise, id, exercise_title, set_index, weight_kg, dim.main_muscle, exercise_name_kaggle, source
    FROM (SELECT *, CASE WHEN routine_id = 'F' THEN 'api' END AS source FROM nested)
    LEFT JOIN mapping ON exercise_title = exercise_title_heavy
    LEFT JOIN dim ON exercise_name_kaggle = dim.p_name"""


@query(with_views("nested catalog mapping", _STREAMED_SQL))
def stream_then_fact(t: Tables) -> DataFrame:
    """One silver table by a stream, a batch job and a second stream that starts anew; the users come
    from rows and from folders, one batch has a new column, and gold reads it all."""
    lake = Lake(t.scratch("lake"))
    raw, silver_path = lake.bronze("workouts"), lake.silver("workouts")
    write_table(t.flat_sets().limit(0), lake.bronze("workouts_base"))
    nested = t.landed_nested()
    users = [r[0] for r in nested.filter("routine_id = 'P'").agg(F.min("user_id")).collect()]
    mine = F.col("user_id") == users[0]
    append_batch(nested.filter("routine_id = 'O'"), raw, DAY)
    write_table(nested.filter(F.col("routine_id").eqNullSafe("P") & mine).drop("user_id"), f"{raw}/user={users[0]}/dt=20240615")
    stream_workouts(t.spark, raw, silver_path, t.scratch("checkpoint")).awaitTermination()
    append_batch(nested.filter("routine_id = 'F'").withColumn("source", F.lit("api")), raw, DAY)
    silver.run_silver_workouts(t.spark, lake)
    append_batch(nested.filter((F.col("routine_id") == "P") & ~mine), raw, DAY)
    stream_workouts(t.spark, raw, silver_path, t.scratch("checkpoint")).awaitTermination()
    silver.run_silver_workouts(t.spark, lake)
    fact = gold.build_fact_sets(silver.read_silver_workouts(t.spark, lake), t.mapping(), t.catalog())
    return fact.select("user_id", "sk_exercise", "id", "exercise_title", "set_index", "weight_kg", "main_muscle", "exercise_name_kaggle", "source")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders")
def compacted_table(t: Tables) -> DataFrame:
    """Many small loads, compacted twice with a load in between, and the old folders deleted."""
    path = t.scratch("orders")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    for k in range(5):
        commit_rows(orders.filter(f"pmod(o_orderkey, 6) = {k}"), path, ["o_orderstatus"])
    compact(t.spark, path, partition_by=["o_orderstatus"])
    commit_rows(orders.filter("pmod(o_orderkey, 6) = 5"), path, ["o_orderstatus"])
    compact(t.spark, path, partition_by=["o_orderstatus"])
    vacuum(t.spark, path, timedelta(0))
    live = live_commits(read_commits(t.spark, path))
    if len(live) != 1:
        raise ValueError(f"{len(live)} commits are left")
    return read_committed(t.spark, path)


_LOGGED = with_views(
    "accounts changes",
    """SELECT c.user_id, updated_at, c.objetivo, c.peso, 20240616 AS dt FROM changes c
    WHERE c.user_id IN (SELECT user_id FROM accounts)""",
)


@query(_LOGGED)
def change_log(t: Tables) -> DataFrame:
    """The log that the profile job writes; ``upsert_text_stamps`` shows its accounts."""
    lake = Lake(t.scratch("lake"))
    write_snapshot(t.accounts(), lake.gold("users_app"), DAY)
    profiles_job.run_profile_changes(t.spark, lake, t.changes().drop("changed"), NEXT_DAY)
    return read_appended(t.spark, lake.bronze("user_form"))


@query(
    with_views(
        "accounts changes",
        """, last AS (SELECT user_id, peso, objetivo FROM changes
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1)
        SELECT a.user_id, a.nome, a.email, a.created_at,
          CASE WHEN l.user_id IS NOT NULL THEN l.objetivo ELSE a.objetivo END AS objetivo,
          CASE WHEN l.user_id IS NOT NULL THEN l.peso ELSE a.peso END AS peso
        FROM accounts a LEFT JOIN last l ON a.user_id = l.user_id""",
    )
)
def upsert_text_stamps(t: Tables) -> DataFrame:
    """Accounts after the profile job; the changes say their time as text, in two zones."""
    lake = Lake(t.scratch("lake"))
    write_snapshot(t.accounts(), lake.gold("users_app"), DAY)
    changes = t.changes().drop("changed").withColumn("updated_at", spelled("updated_at", "objetivo"))
    profiles_job.run_profile_changes(t.spark, lake, changes, NEXT_DAY)
    return read_latest_snapshot(t.spark, lake.gold("users_app")).drop("snapshot_date")


@query(
    with_views(
        "accounts changes",
        """, picked AS (SELECT * FROM changes WHERE CAST(user_id AS BIGINT) % 10 = 3),
        last AS (SELECT user_id, peso, objetivo FROM picked
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1),
        fresh AS (SELECT lower(s_name) || '@example.com' AS email, s_name AS nome, md5(lower(s_name) || '@example.com') AS h FROM supplier)
        SELECT a.user_id, a.nome, a.email, a.created_at,
          CASE WHEN l.user_id IS NOT NULL THEN l.objetivo ELSE a.objetivo END AS objetivo,
          CASE WHEN l.user_id IS NOT NULL THEN l.peso ELSE a.peso END AS peso
        FROM accounts a LEFT JOIN last l ON a.user_id = l.user_id
        UNION ALL SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
          || substr(h, 17, 4) || '-' || substr(h, 21, 12), nome, email, '2024-06-15', NULL, NULL FROM fresh""",
    )
)
def bucketed_accounts(t: Tables) -> DataFrame:
    """Accounts by buckets after changes of every tenth user, new accounts, and the same ones again."""
    lake = Lake(t.scratch("lake"))
    write_snapshot(t.accounts(), lake.gold("users_app"), DAY)
    profiles_job.create_accounts(t.spark, lake, buckets=32)
    changes = t.changes().drop("changed").filter("CAST(user_id AS BIGINT) % 10 = 3")
    profiles_job.merge_profile_changes(t.spark, lake, changes, NEXT_DAY)
    asked = t.supplier.select(F.concat(F.upper("s_name"), F.lit("@EXAMPLE.com ")).alias("email"), F.col("s_name").alias("nome"))
    asked = asked.unionAll(t.customer.select(F.concat(F.col("c_name"), F.lit("@example.com")), "c_name"))
    for _ in range(2):
        profiles_job.merge_new_accounts(t.spark, lake, asked, created_at=F.lit("2024-06-15"))
    return read_buckets(t.spark, lake.gold("accounts"))


STAR_SQL = """WITH m AS (SELECT DISTINCT l_partkey, l_returnflag AS muscle FROM lineitem),
    i AS (SELECT DISTINCT l_partkey, l_linenumber AS step_number, l_linestatus AS instruction FROM lineitem)
    SELECT CAST(p_partkey AS VARCHAR) AS exercise_id, p_name AS exercise_name, p_brand AS equipment,
      p_type AS main_muscle, muscle, step_number, instruction
    FROM part LEFT JOIN m ON p_partkey = m.l_partkey LEFT JOIN i ON p_partkey = i.l_partkey"""


@query(STAR_SQL)
def gold_contract(t: Tables) -> DataFrame:
    """The exercise view by its job, which holds the star to its contracts."""
    lake = Lake(t.scratch("lake"))
    key = F.col("l_partkey").cast("string").alias("exercise_id")
    none = [F.lit(None).cast("string").alias(c) for c in ("variation", "utility", "mechanics", "force")]
    exercises = t.part.select(
        F.col("p_partkey").cast("string").alias("exercise_id"),
        F.col("p_name").alias("exercise_name"),
        F.col("p_brand").alias("equipment"),
        *none,
        F.col("p_type").alias("main_muscle"),
        F.lit(None).cast("int").alias("difficulty_(1_5)"),
    )
    muscles = t.lineitem.select(key, F.col("l_returnflag").alias("muscle"), F.lit("main").alias("muscle_type"))
    steps = t.lineitem.select(key, F.col("l_linenumber").cast("int").alias("step_number"), F.col("l_linestatus").alias("instruction"))
    write_table(exercises, lake.gold("exercises_dim"))
    write_table(muscles.distinct(), lake.gold("muscles_bridge"))
    write_table(steps.distinct(), lake.gold("instructions_bridge"))
    return read_table(t.spark, star.run_gold_view(t.spark, lake))


@query(with_views("workouts", _TEXT_SQL + _PROFILE_SQL))
def context_job(t: Tables) -> DataFrame:
    path = context.run_context(
        t.spark, profiles(t), t.workouts(), as_of(), t.scratch("context"), tie_break=["workout_id"]
    )
    return read_table(t.spark, path)
