"""Writes that hold their rows to expectations: one pass writes, counts and sets aside.

The rows of a load are judged while they are written. Good ones go to the folder of the commit, bad
ones with the names of the rules that they break to a folder beside it, by the same job, which
also counts them. The commit is published only if the counts allow it. Until then no reader sees
anything, and after a refusal the bad rows can still be looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.operators.quality import require_contract
from trainlake.sources.commits import LOADED_BY, Commit, _publish, read_commits
from trainlake.sources.readers import child_folders
from trainlake.sources.writers import clustered

BROKEN = "broken_rules"
ASIDE = "-aside"


@dataclass(frozen=True)
class Rule:
    """A condition that good rows meet; NULL does not. Rows that break it are set aside, and the
    load is refused if their share is above ``tolerance``."""

    name: str
    good: Column | str
    tolerance: float = 1.0

    def holds(self) -> Column:
        good = F.expr(self.good) if isinstance(self.good, str) else self.good
        return F.coalesce(good, F.lit(False))


def not_null(col: str, tolerance: float = 1.0) -> Rule:
    return Rule(f"{col} is there", f"`{col}` IS NOT NULL", tolerance)


def within(col: str, low, high, tolerance: float = 1.0) -> Rule:
    """A value between both limits (numbers or text), or none."""
    return Rule(f"{col} from {low} to {high}", f"`{col}` IS NULL OR `{col}` BETWEEN {low!r} AND {high!r}", tolerance)


@dataclass(frozen=True)
class Report:
    """What a checked load has found; ``commit`` is None if it was refused, for the ``reasons``."""

    name: str
    rows: int
    aside: int
    broken: Mapping[str, int]
    commit: Commit | None
    reasons: Sequence[str] = field(default_factory=tuple)


class Refused(ValueError):
    """A load that breaks its rules; has the report."""

    def __init__(self, report: Report):
        super().__init__("; ".join(report.reasons))
        self.report = report


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` and in ``broken_rules`` the names of the rules that a row breaks, NULL for a good one.
    A projection: no second look at the source."""
    names = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull()) if rules else F.array().cast("array<string>")
    return df.withColumn(BROKEN, F.when(F.size(names) > 0, names))


def commit_checked(
    df: DataFrame,
    path: str,
    rules: Sequence[Rule],
    unique: Sequence[str] = (),
    contract: T.StructType | str | None = None,
    least_rows: int = 1,
    partition_by: Sequence[str] = (),
) -> Report:
    """Commit the good rows of ``df`` to the table ``path`` and set the others aside.

    The load is refused with ``Refused``, and nothing of it published, if a rule is broken by more
    than its tolerance, if fewer than ``least_rows`` good rows are there, or if they repeat the
    values of ``unique``, which is looked up in these columns of the rows just written. A
    ``contract`` is compared with the schema before anything runs.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    if contract is not None:
        require_contract(df, contract, root.rsplit("/", 1)[-1])
    before = read_commits(spark, root)
    number = before[-1].number + 1 if before else 0
    name = f"q{number:012d}-{datetime.now(timezone.utc).strftime('%Y%m%d%H%M%S%f')}"
    counts = [F.count(F.lit(1)).alias("rows"), F.count(BROKEN).alias("aside")]
    counts += [F.count_if(F.array_contains(BROKEN, r.name)).alias(f"rule_{k}") for k, r in enumerate(rules)]
    seen = Observation()
    out = judged(df.withColumn(LOADED_BY, F.lit(name)), rules).withColumn("commit", F.when(F.col(BROKEN).isNull(), F.lit(name)).otherwise(F.lit(name + ASIDE)))
    out = clustered(out, partition_by, partition_by) if partition_by else out
    out.observe(seen, *counts).write.mode("append").partitionBy("commit", *partition_by).parquet(root)
    found = seen.get
    rows, aside = found["rows"], found["aside"]
    broken = {r.name: found[f"rule_{k}"] for k, r in enumerate(rules)}
    reasons = [f"{broken[r.name]} of {rows} rows break the rule: {r.name}" for r in rules if rows and broken[r.name] > r.tolerance * rows]
    if rows - aside < least_rows:
        reasons.append(f"{rows - aside} good rows, of {least_rows} at least")
    schema = df.withColumn(LOADED_BY, F.lit(name)).schema
    if unique and rows > aside:
        keys = [F.col(f"`{c}`") for c in unique]
        written = spark.read.schema(schema).option("basePath", root).parquet(f"{root}/commit={name}").select(*keys).dropna()
        repeated = [tuple(r)[:-1] for r in written.groupBy(*keys).count().filter("count > 1").limit(5).collect()]
        if repeated:
            reasons.append(f"{', '.join(unique)} is not unique, for example {repeated}")
    if reasons:
        raise Refused(Report(name, rows, aside, broken, None, tuple(reasons)))
    stamp = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    entry = Commit(number, name, rows - aside, 0, schema.json(), (), True, stamp)
    _publish(spark, root, entry)
    return Report(name, rows, aside, broken, entry)


def read_quarantine(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The rows set aside by all loads, refused ones too, or by the load ``name``: with the rules they
    break and their ``load_batch``."""
    root = path.rstrip("/")
    found = [f for f in child_folders(spark, root) if f.startswith("commit=") and f.endswith(ASIDE)]
    if name is not None:
        found = [f for f in found if f == f"commit={name}{ASIDE}"]
    if not found:
        raise RuntimeError(f"nothing was set aside in {path}")
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(*[f"{root}/{f}" for f in found]).drop("commit")
