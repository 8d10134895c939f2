"""Scans of bronze, silver and gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.operators.shape import for_user
from trainlake.sources.csv_records import inferred_schema, read_split_csv
from trainlake.schemas import RAW_WORKOUT, WORKOUT_CSV, WORKOUT_PAGE


BROKEN = "_broken_record"


def read_workout_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Flat workout sets with their declared schema; text times stay text."""
    return read_csv(spark, path, WORKOUT_CSV, multi_line)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    broken: str = "fail",
) -> DataFrame:
    """CSV with header. Without a schema the types are inferred by one more scan.

    Files are read by many tasks. ``multi_line`` allows line ends inside quotes: records are then put
    together from the lines of each byte range, see ``csv_records``, which moves the lines once;
    a feed without such text can turn it off.

    A record that does not fit the schema, such as one that a line end inside quotes has
    cut in two, is never returned as a row of NULLs: ``broken="fail"`` ends the read with an
    error, ``broken="aside"`` returns it with its text in ``_broken_record``, where
    ``split_broken`` takes it apart from the rows.
    """
    if broken not in ("fail", "aside"):
        raise ValueError("broken must be 'fail' or 'aside'")
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is None:
        schema = inferred_schema(spark, path) if multi_line else reader.option("inferSchema", True).csv(path).schema
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if multi_line:
        return read_split_csv(spark, path, declared, BROKEN if broken == "aside" else None)
    if broken == "fail":
        # Spark skips the check of columns that nobody reads, and with it the broken records.
        return reader.schema(declared).option("mode", "FAILFAST").option("columnPruning", False).csv(path)
    with_broken = T.StructType([*declared.fields, T.StructField(BROKEN, T.StringType())])
    return reader.schema(with_broken).option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False).csv(path)


def split_broken(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read_csv(..., broken="aside")``, and the broken records with their text and
    what could be read of them. Write the latter before counting them: Spark does not read the
    text of a record alone."""
    whole = df.filter(F.col(BROKEN).isNull()).drop(BROKEN)
    return whole, df.filter(F.col(BROKEN).isNotNull())


def read_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A table that one write has made."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """A table that several writes have made: the columns of all its files. Spark reads the
    footers of the files for that, in parallel."""
    return spark.read.option("mergeSchema", True).parquet(path)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, by one listing of that folder alone; none
    where it does not exist."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(place) if s.isDirectory())


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV when the name ends so or the folder holds only such files, else Parquet."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, schema)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if not file_listing(spark, path, "*.csv").isEmpty():
            return read_csv(spark, path, schema)
        raise


def file_listing(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Path, change time and length of all files below ``prefix``; contents stay unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(prefix).select("path", "modificationTime", "length")


def latest_path(spark: SparkSession, prefix: str, fmt: str = "parquet") -> str:
    """Newest table below ``prefix``: a single file, or the root folder of a Spark write. The
    ``key=value`` folders of a partitioned write belong to it; a folder of one delivery
    (``snapshot_date=``, ``dt=``, ``day=``) is a table of its own."""
    files = file_listing(spark, prefix, f"*.{fmt}")
    is_part = F.regexp_extract("path", "([^/]*)$", 1).startswith("part-")
    root = F.regexp_replace("path", "(/(?!snapshot_date=|dt=|day=)[^/=]+=[^/]*)*/[^/]*$", "")
    table = F.when(is_part, root).otherwise(F.col("path"))
    newest = files.agg(F.max_by(table, F.struct("modificationTime", "path"))).first()[0]
    if newest is None:
        raise RuntimeError(f"no {fmt} file below {prefix}")
    return newest


def read_latest(
    spark: SparkSession,
    prefix: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The newest table below ``prefix`` and nothing else of it."""
    path = latest_path(spark, prefix, fmt)
    return read_csv(spark, path, schema) if fmt == "csv" else read_table(spark, path)


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest ``snapshot_date=`` folder of a table, with that date as a column.

    Only the names of the folders are listed, and only the newest one is read, so its columns
    are its own and not those of the first snapshot.
    """
    root = path.rstrip("/")
    dates = [f.partition("=")[2] for f in child_folders(spark, root) if f.startswith("snapshot_date=")]
    newest = max((d for d in dates if d.isdigit()), default=None)
    if newest is None:
        raise RuntimeError(f"no snapshot below {path}")
    return spark.read.option("basePath", root).parquet(f"{root}/snapshot_date={newest}")


def read_folder(spark: SparkSession, prefix: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Union of all Parquet files by column name; a missing folder is an empty table."""
    try:
        return (
            spark.read.option("mergeSchema", True)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .parquet(prefix)
        )
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def read_increments(
    spark: SparkSession,
    prefix: str,
    exclude: str | None = "base_full.parquet",
    schema: T.StructType | str = RAW_WORKOUT,
    day: date | None = None,
    user: str = "user_id",
    files: Sequence[str] | None = None,
) -> DataFrame:
    """All raw batches below ``prefix`` without the base file of that name.

    The columns are those of all batches and of ``schema``; new ones are kept. A batch that
    has no ``user`` column has its user in the name of its ``user=`` folder. ``day`` reads the
    ``dt=`` folders of one day alone, ``files`` the files of those names.
    """
    root = prefix.rstrip("/")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = [root] if files is None else list(files)
    if not paths:
        return spark.createDataFrame([], declared).withColumn(user, F.lit(None).cast("string"))
    if day is not None:
        name = f"dt={day.strftime('%Y%m%d')}"
        folders = child_folders(spark, root)
        users = [f for f in folders if f.startswith("user=")]
        paths = [f"{root}/{name}"] if name in folders else []
        paths += [f"{root}/{u}/{name}" for u in users if name in child_folders(spark, f"{root}/{u}")]
        if not paths:
            return spark.createDataFrame([], declared).withColumn(user, F.lit(None).cast("string"))
    df = (
        spark.read.option("mergeSchema", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(*paths)
    )
    place = F.col("_metadata.file_path")
    columns = [F.col(f"`{c}`") for c in df.columns if c != user]
    columns += [F.lit(None).cast(f.dataType).alias(f.name) for f in declared.fields if f.name not in df.columns]
    if exclude is not None:
        # The base is one file, or the folder of that name a Spark write makes.
        df = df.filter(~place.rlike(f"{exclude.replace('.', '[.]')}(/[^/]*)?$"))
    return df.select(*columns, user_of(df, user).alias(user))


def user_of(df: DataFrame, user: str = "user_id") -> Column:
    """The user of raw rows: their own column, or else the name of their ``user=`` folder."""
    folder = F.nullif(F.regexp_extract("_metadata.file_path", "/user=([^/]*)/", 1), F.lit(""))
    own = F.col(user).cast("string") if user in df.columns else F.lit(None).cast("string")
    return F.coalesce(own, F.url_decode(folder))


def read_workout_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed API pages to one row per workout."""
    pages = spark.read.schema(WORKOUT_PAGE).option("multiLine", multi_line).json(path)
    return pages.select(F.explode("workouts").alias("w")).select("w.*")


def normalize_documents(df: DataFrame) -> DataFrame:
    """Exported documents: ``_id`` serves as ``user_id`` where there is none, then goes."""
    if "_id" not in df.columns:
        return df
    key = F.col("_id").cast("string")
    if "user_id" in df.columns:
        key = F.coalesce(F.col("user_id").cast("string"), key)
    return df.withColumn("user_id", key).drop("_id")


def load_fact(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """The fact, or one user's rows: from the files that its zone map names, or without one by a
    predicate that the Parquet scan can use."""
    if user_id is None:
        return read_table(spark, path)
    from trainlake.sources.zones import files_where

    files = files_where(spark, path, "user_id", user_id)
    if files is None:
        return for_user(read_table(spark, path), user_id)
    if not files:
        return read_table(spark, path).limit(0)
    return for_user(spark.read.option("basePath", path.rstrip("/")).parquet(*files), user_id)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric STRING, key STRING, value DOUBLE").json(path)
