"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.session import apply_defaults, scratch_path

#: Rows go to Python in batches of so many bytes, however long the texts are.
BATCH_BYTES = 4 << 20


def ship_by_value(module: str) -> None:
    """Send the functions of ``module`` to the Python workers whole, so that workers need no
    installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's defaults and batches bounded by their bytes."""
    apply_defaults(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that ``df`` does not have; Spark ignores case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct ``row`` beside the columns ``more``: whatever columns the rows have,
    none clashes. ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text becomes the empty one. Whatever else the rows
    carry, also columns named like those that an operator adds, is left behind."""
    return docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


#: Spark's setting for deleting the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors. What was
    shuffled for it is deleted once it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most_bytes`` in each; a longer text stays
    whole in a slice of its own. Bounds the memory of what is derived from a slice, and returns
    what was free at the end of the task, because workers live on."""
    try:
        yield from cut_batches(batches, column, most_bytes)
    finally:
        release_memory()


def release_memory() -> None:
    import gc

    gc.collect()
    trim_memory()


def trim_memory() -> None:
    """Return what is free already, without a search for cycles: cheap enough for each group or task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = text_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(offsets.searchsorted(offsets[start] + most_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_offsets(texts: pa.Array):
    """Byte offsets of a string or binary array into its data buffer."""
    import numpy as np

    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array):
    """All UTF-8 bytes of a string array without nulls as one numpy array, and the offsets into it."""
    import numpy as np

    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
