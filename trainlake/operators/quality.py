"""Data dictionaries, profiles, file inventories and checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.sources.readers import file_listing, read_any

# The two kinds of variable in a data dictionary.
NUMERIC = "Numérica"
CATEGORICAL = "Categórica"


def data_dictionary(df: DataFrame, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """Column, description, type and kind of each column; made from the schema alone."""
    descriptions = descriptions or {}
    rows = [
        (
            f.name,
            descriptions.get(f.name, f"Descrição da coluna {f.name}"),
            f.dataType.simpleString(),
            NUMERIC if isinstance(f.dataType, T.NumericType) else CATEGORICAL,
        )
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name STRING, description STRING, dtype STRING, kind STRING"
    )


def profile(df: DataFrame) -> DataFrame:
    """Type, rows, NULLs and smallest value of each column, from one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    pairs = []
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name}`")
        aggs.append(F.count(F.when(col.isNull(), F.lit(1))).alias(f"_nulls_{i}"))
        simple = not isinstance(f.dataType, (T.MapType, T.BinaryType))
        sample = F.min(col).cast("string") if simple else F.lit(None).cast("string")
        aggs.append(sample.alias(f"_sample_{i}"))
        pairs.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("_rows").alias("n_rows"),
                F.col(f"_nulls_{i}").alias("n_null"),
                F.col(f"_sample_{i}").alias("sample"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*pairs)))


def file_inventory(spark: SparkSession, prefix: str) -> DataFrame:
    """Files, bytes and newest change per folder. Only the listing is read, no content."""
    files = file_listing(spark, prefix)
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("n_bytes"),
        F.max("modificationTime").alias("newest"),
    )


def layer_tables(spark: SparkSession, prefix: str) -> list[str]:
    """Folders below ``prefix`` that hold data files. ``key=value`` folders are partitions
    and count as their table; the list has one entry per table."""
    files = file_listing(spark, prefix).filter(F.col("path").rlike(r"(?i)\.(parquet|csv)$"))
    folder = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "(/[^/=]+=[^/]*)+$", "")
    return [r.folder for r in files.select(folder.alias("folder")).distinct().orderBy("folder").toLocalIterator()]


def layer_schemas(spark: SparkSession, prefix: str) -> DataFrame:
    """Table, column, type and file count of every table of a layer."""
    root = prefix.rstrip("/")
    rows = []
    for folder in layer_tables(spark, root):
        name = folder.rsplit(root.rsplit("/", 1)[-1] + "/", 1)[-1]
        rows += [(folder, name, column, dtype) for column, dtype in read_any(spark, folder).dtypes]
    schemas = spark.createDataFrame(
        rows, "_folder STRING, table_name STRING, column_name STRING, dtype STRING"
    )
    table = F.regexp_replace("folder", "(/[^/=]+=[^/]*)+$", "").alias("_folder")
    counts = file_inventory(spark, root).groupBy(table).agg(F.sum("n_files").alias("n_files"))
    return schemas.join(counts, "_folder", "left").drop("_folder")


def layer_previews(spark: SparkSession, prefix: str, n: int = 5) -> dict[str, DataFrame]:
    """The first ``n`` rows of every table of a layer."""
    return {t: read_any(spark, t).limit(n) for t in layer_tables(spark, prefix.rstrip("/"))}


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once; an empty result passes."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Rows without a value; an empty result passes."""
    return df.filter(F.col(col).isNull())


def schema_differences(df: DataFrame, contract: T.StructType | str) -> list[tuple]:
    contract = T.StructType.fromDDL(contract) if isinstance(contract, str) else contract
    want = {f.name: f.dataType.simpleString() for f in contract.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for name in [*want, *[n for n in have if n not in want]]:
        if name not in have:
            status = "missing"
        elif name not in want:
            status = "undeclared"
        else:
            status = "ok" if have[name] == want[name] else "type"
        rows.append((name, want.get(name), have.get(name), status))
    return rows


def check_schema(df: DataFrame, contract: T.StructType | str) -> DataFrame:
    """Declared against actual type of each column: ok, type, missing or undeclared."""
    return df.sparkSession.createDataFrame(
        schema_differences(df, contract),
        "column_name STRING, expected STRING, actual STRING, status STRING",
    )


def require_contract(df: DataFrame, contract: T.StructType | str, name: str = "table") -> DataFrame:
    """The table itself, or an error when a declared column is missing or of another type. Only
    the schema is looked at; undeclared columns are allowed."""
    faults = [r for r in schema_differences(df, contract) if r[3] in ("missing", "type")]
    if faults:
        raise ValueError(f"{name} breaks its contract: {faults}")
    return df


def require_unique(df: DataFrame, col: str, name: str = "table") -> DataFrame:
    """The table itself, or an error that shows some values that occur more than once."""
    found = [r[0] for r in check_unique(df, col).limit(5).collect()]
    if found:
        raise ValueError(f"{name}.{col} is not unique, for example {found}")
    return df


def require_not_null(df: DataFrame, col: str, name: str = "table") -> DataFrame:
    """The table itself, or an error when a row has no value."""
    if not check_not_null(df, col).isEmpty():
        raise ValueError(f"{name}.{col} has rows without a value")
    return df


def require_rows(df: DataFrame, name: str = "source") -> DataFrame:
    """The table itself, or an error when it has no rows. Reads at most one row."""
    if df.isEmpty():
        raise RuntimeError(f"{name} has no rows")
    return df
