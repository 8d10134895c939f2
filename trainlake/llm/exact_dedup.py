"""Exact duplicates of whole texts, combined in steps that no hot text can overload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import carried, col, id_and_text, written

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``digest``, ``text``, ``keep_id`` (largest id), ``group_size``.

    1. Each task combines the equal texts of its own rows before anything is shuffled.
    2. What the tasks have found is merged within (digest, salt); the salt is the task's number
       modulo ``salts``, so one hot text is merged in up to ``salts`` places.
    3. The winners of the salts are combined per digest.

    The whole text is a grouping key at every step: texts with one digest never mix.
    """
    salted = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text is the empty one. The largest id of a group
    stays. Repeated rows (same id and text) count each, and one of them is kept. Rows without an
    id lose to rows with one; in a group without any id, ``keep_id`` is null and one row is kept.
    An empty table gives an empty result; other columns are ignored.

    The rows find their group by the digest and a second hash of the text. Should two different
    texts agree in both, which the written groups show, the rows are matched by the whole text.
    """
    rows = id_and_text(docs, id_col, text_col)
    named = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"))
    groups = winners(rows, digest, salts)
    keys = ["digest", "second"]
    slim = written(groups.select("digest", F.xxhash64("text").alias("second"), "keep_id", "group_size"), "dedup-groups")
    if not slim.groupBy(*keys).count().filter("count > 1").isEmpty():
        keys = ["digest", "second", "text"]
        slim = groups.withColumn("second", F.xxhash64("text"))
    counted = named.groupBy("doc_id", *keys, F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    joined = counted.join(slim, keys)
    copies = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup_exact`` marks as kept, all columns: one row of each text.
    Of rows that repeat id and text, with an id or without, one stays, chosen by the hash of all
    columns but maps.

    Rows are matched and numbered by one key, so that the numbering needs no shuffle after a
    shuffled join; after another join, each task leaves one row of a key before the shuffle. They
    are carried as one column, so input columns of any name stay as they are."""
    kept = dedup_exact(docs, id_col, text_col).filter("kept").select(_row_key(F.col("text_sha256"), F.col("doc_id")).alias("key"))
    hashed = F.xxhash64(*[col(c) for c, kind in docs.dtypes if "map<" not in kind])
    keyed = carried(docs, key=_row_key(F.sha2(F.coalesce(col(text_col), F.lit("")), 256), col(id_col)), place=hashed)
    same = keyed.join(kept, "key", "left_semi")
    numbered = same.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("place")))
    return numbered.filter("place = 1").select("row.*")


def _row_key(sha: Column, doc_id: Column) -> Column:
    """The text's hash and the id in one text; without an id, the hash alone."""
    return F.concat_ws(":", sha, doc_id.cast("string"))
