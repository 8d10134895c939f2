"""Incremental loads as a batch: of rows since a high-water mark, and of files not yet consumed."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trainlake.operators.shape import filter_since
from trainlake.sources.commits import MAX_FILES, Commit, commit_rows, file_names, new_files, pinned
from trainlake.sources.readers import read_increments
from trainlake.sources.state import read_watermark, write_watermark
from trainlake.sources.writers import append_batch


def ingest_incremental(
    spark: SparkSession,
    raw: DataFrame,
    state: str,
    dst: str,
    day: date,
    ts: str = "updated_at",
    fallback: str | None = None,
    user: str = "user_id",
    by_user: bool = False,
) -> datetime | None:
    """Append the workouts changed since the stored mark, then move the mark.

    The stamps alone decide, not the day that a folder is named for: a batch may land under a
    local day before that of the mark. A feed of files is better loaded by ``ingest_new_files``,
    which opens no file twice and takes late rows too.

    The new mark is observed while the batch is written, so the source is read once. The
    data goes first: a crash between the two steps repeats the batch (at least once).
    Returns the new mark, or None when nothing was new.
    """
    since = read_watermark(spark, state)
    bound = None if since is None else F.lit(since)
    stamp = F.col(ts) if fallback is None else F.coalesce(F.nullif(F.col(ts), F.lit("")), F.col(fallback))
    seen = Observation()
    figures = [
        F.count(F.lit(1)).alias("n"),
        F.max(F.unix_micros(stamp.try_cast("timestamp"))).alias("mark"),
    ]
    new = filter_since(raw, bound, ts, fallback)
    append_batch(new, dst, day, user, by_user, observe=(seen, figures))
    if not seen.get["n"] or seen.get["mark"] is None:
        return None
    seconds, rest = divmod(seen.get["mark"], 1_000_000)
    mark = datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)
    write_watermark(spark, state, mark)
    return mark


def ingest_new_files(
    spark: SparkSession,
    src: str,
    dst: str,
    exclude: str | None = "base_full.parquet",
    partition_by: tuple[str, ...] = (),
    max_files: int | None = MAX_FILES,
) -> list[Commit]:
    """Load every raw file below ``src`` that the table ``dst`` has not consumed, exactly once.

    Late files, files under an earlier day, a second batch of one day and a repeated run need no
    care: the ledger of ``dst`` knows what was read, and is committed with the rows. Rows keep
    all columns, and have the user of their ``user=`` folder. At most ``max_files`` go into one
    commit; as many commits follow as there are files.
    """
    out = []
    while True:
        files = pinned(new_files(spark, src, dst, exclude=exclude, most=max_files))
        names = file_names(files)
        if not names:
            return out
        rows = read_increments(spark, src, None, files=names)
        out.append(commit_rows(rows, dst, partition_by, files=files))
