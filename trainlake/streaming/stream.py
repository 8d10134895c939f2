"""Incremental load as a file stream."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trainlake.functions.dates import month_of
from trainlake.functions.values import with_duration, with_id_string
from trainlake.operators.nested import explode_workouts
from trainlake.schemas import RAW_WORKOUT
from trainlake.sources.commits import commit_rows, consumed_files, pinned
from trainlake.sources.readers import user_of

BASE_FILE = "base_full.parquet"

MAX_FILES = 10_000


FILE = ("_file", "_length", "_changed")


def raw_schema(spark: SparkSession, src: str, user: str = "user_id") -> T.StructType:
    """The columns of the files that are there when the stream starts, and the declared ones. A
    stream has one schema; a column that appears later is read from the next start on."""
    declared = {f.name: f for f in [*RAW_WORKOUT.fields, T.StructField(user, T.StringType())]}
    try:
        reader = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        found = {f.name: T.StructField(f.name, f.dataType) for f in reader.parquet(src).schema.fields}
    except AnalysisException:
        found = {}
    return T.StructType(list((found | {k: f for k, f in declared.items() if k not in found}).values()))


def raw_stream(
    spark: SparkSession,
    src: str,
    max_files: int | None = MAX_FILES,
    exclude: str | None = BASE_FILE,
    user: str = "user_id",
) -> DataFrame:
    """New raw files below ``src`` as a stream, at most ``max_files`` in a batch, so that a backlog is
    worked off in several. Rows have all columns, the user of their ``user=`` folder where they
    name none, and the file they come from (``_file, _length, _changed``)."""
    reader = (
        spark.readStream.schema(raw_schema(spark, src, user))
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(src)
    if exclude is not None:
        df = df.filter(~F.col("_metadata.file_path").rlike(f"/{re.escape(exclude)}(/[^/]*)?$"))
    meta = ("file_path", "file_size", "file_modification_time")
    places = [F.col(f"_metadata.{m}").alias(name) for m, name in zip(meta, FILE, strict=True)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != user], user_of(df, user).alias(user), *places)


def stream_workouts(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    user_id: str | None = None,
    max_files: int | None = MAX_FILES,
    partition_by: Sequence[str] = ("start_month",),
) -> StreamingQuery:
    """Explode every new raw file and append its sets to the silver table.

    Runs over what has arrived and stops. A batch is one commit of the table, in the layout that the
    batch job writes, named by the query and the batch: one that is run again after a crash counts
    once. Files that the ledger has, from this stream or a batch job, are left out, and those of
    the batch are added to it. Rows are brought together by ``partition_by``.
    """

    def land(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        file, length, changed = FILE
        listed = batch.select(F.col(file).alias("file"), F.col(length).alias("length"), F.col(changed).alias("changed")).distinct()
        files = pinned(listed.join(consumed_files(session, dst), ["file", "length", "changed"], "left_anti"))
        if files.isEmpty():
            return
        fresh = batch.join(files.select(F.col("file").alias(file), F.col("changed").alias(changed)), [file, changed], "left_semi").drop(*FILE)
        sets = with_id_string(with_duration(explode_workouts(fresh, user_id, extra=True))).withColumn("start_month", month_of("start_time"))
        # The query's id lives in the checkpoint: numbers start anew with a new one.
        query = session.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        commit_rows(sets, dst, partition_by, files=files, name=f"s-{query}-{number}")

    return (
        raw_stream(spark, src, max_files)
        .writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
