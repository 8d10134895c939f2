"""CSV whose texts may have line ends, read by many tasks per file.

The multi-line reader gives a whole file to one task, because only the quotes before a line say
whether it begins a record. Their parity is enough for that, and parity adds up:

1. A first scan counts, for each part of a byte range that Spark makes of a file, the lines with an odd
   number of quotes, and notes the first and the last of them: one row per part. A part has
   at most ``1 << PART_BITS`` lines.
2. A running sum over those rows says which parts begin inside a quoted text. The lines of such a
   part up to its first odd line belong to the record that an earlier part left open.
3. A second scan hands each line to the part in which its record begins. There a running sum over
   the part's lines finds the records, and their lines are put together.
4. Each record is parsed by itself.

Lines are moved once, by part, to as many tasks as the size of the files asks for, so what a task
sorts does not grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many rows of parts go to all tasks; with more, parts and lines are joined by a shuffle.
BROADCAST_RANGES = 1 << 19
PART_BITS = 16
#: Lines are dealt so that a task gets about so many bytes of the files.
TASK_BYTES = 32 << 20


def quoted_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of the files with their ``file``, the start of their byte range (``block``), a
    number that grows along the range, and whether they have an odd number of quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        (F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1).alias("odd"),
    )


def with_parts(lines: DataFrame) -> DataFrame:
    """The lines with their ``part`` of the range; it grows along the range."""
    return lines.withColumn("part", F.shiftright("line", PART_BITS))


def range_edges(lines: DataFrame) -> DataFrame:
    """One row per part: whether it begins inside quotes (``inside``), its ``first_odd`` line, the
    block and part that began the record which is open there (``origin``), and whether it has
    the first record of its file (``header``)."""
    odd = F.when(F.col("odd"), F.col("line"))
    filled = F.count_if(~blank("value"))
    figures = lines.groupBy("file", "block", "part").agg(F.count(odd).alias("n_odd"), F.min(odd).alias("first_odd"), filled.alias("filled"))
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    return figures.select(
        "file",
        "block",
        "part",
        "first_odd",
        (F.pmod(F.coalesce(F.sum("n_odd").over(before), F.lit(0)), F.lit(2)) == 1).alias("inside"),
        F.last(F.when(F.col("n_odd") > 0, F.struct("block", "part")), ignorenulls=True).over(before).alias("origin"),
        ((F.col("filled") > 0) & (F.coalesce(F.sum("filled").over(before), F.lit(0)) == 0)).alias("header"),
    )


def blank(line: str) -> Column:
    return F.trim(F.replace(line, F.lit("\r"), F.lit(""))) == ""


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, record``: the text of each record without its line end, the header of each file left
    out. Quotes are those of RFC 4180: around whole fields, doubled inside. Lines that are blank
    outside quotes are no records."""
    lines = with_parts(quoted_lines(spark, path))
    edges = range_edges(with_parts(quoted_lines(spark, path)))
    bound, total = range_bound(spark, path)
    if bound + (total >> PART_BITS) <= BROADCAST_RANGES:
        edges = F.broadcast(edges)
    placed = lines.join(edges, ["file", "block", "part"])
    carried = F.col("inside") & (F.col("first_odd").isNull() | (F.col("line") <= F.col("first_odd")))
    home = F.when(carried, F.col("origin")).otherwise(F.struct("block", "part"))
    order = Window.partitionBy("file", "home").orderBy("block", "line")
    odd = F.col("odd").cast("int")
    # The header's part is known to its own lines; a record that goes on in other parts begins in it.
    found = placed.select("file", home.alias("home"), "block", "line", "value", "odd", (F.col("header") & ~carried).alias("header"))
    found = found.repartition(2 + total // TASK_BYTES, "file", "home")
    found = found.withColumn("open", F.pmod(F.sum(odd).over(order) - odd, F.lit(2)) == 1)
    found = found.withColumn("starts", ~F.col("open") & ~blank("value"))
    found = found.withColumn("number", F.sum(F.col("starts").cast("int")).over(order))
    kept = found.filter("open OR starts")
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    whole = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    records = kept.groupBy("file", "home", "number").agg(whole.alias("record"), F.bool_or("header").alias("header"))
    records = records.filter("NOT header OR number > 1")
    return records.select("file", F.regexp_replace("record", "\r$", "").alias("record"))


def range_bound(spark: SparkSession, path: str | list[str]) -> tuple[int, int]:
    """An upper bound of the number of ranges, and the bytes of the files, from a listing."""
    files = spark.read.format("binaryFile").load(path).select("length")
    total, n = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cost = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    # Spark cuts small inputs finer, to use all cores, but not below the cost of opening a file.
    return n + total // max(1, min(size, max(cost, total // spark.sparkContext.defaultParallelism))), total


def read_split_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, broken: str | None = None) -> DataFrame:
    """The typed rows of the records. A record that does not fit the schema ends the read, or, where
    ``broken`` names a column, has its text there."""
    options = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    if broken is not None:
        schema = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = csv_records(spark, path).select(F.from_csv("record", F.lit(ddl), options).alias("r"))
    return rows.select("r.*")


#: Types that an undeclared column may have, in this order, with what its texts must look like.
INFERRED = {"int": None, "bigint": None, "double": None, "date": r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$", "timestamp": None, "boolean": None}


def inferred_schema(spark: SparkSession, path: str | list[str]) -> T.StructType:
    """The first type that all texts of a column fit, from one more pass by all tasks; text where
    none does, or the column is empty. Names come from the first file's header."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    plain = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    rows = read_split_csv(spark, path, plain)
    aggs = []
    for k in range(len(names)):
        text = F.col(f"c{k}")
        for kind, form in INFERRED.items():
            fits = text.try_cast(kind).isNotNull() if form is None else text.rlike(form) & text.try_cast(kind).isNotNull()
            aggs.append(F.bool_and(F.when(text.isNotNull(), fits)).alias(f"c{k}_{kind}"))
    found = rows.agg(*aggs).first()
    ddl = [next((kind for kind in INFERRED if found[f"c{k}_{kind}"]), "string") for k in range(len(names))]
    fields = [T.StructType.fromDDL(f"x {kind}")[0].dataType for kind in ddl]
    return T.StructType([T.StructField(n, f) for n, f in zip(names, fields, strict=True)])
