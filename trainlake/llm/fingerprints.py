"""Document fingerprints by Order MinHash: likeness that falls with edits and with reordering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import id_and_text, ship_by_value, shuffle_partitions, slices, written
from trainlake.llm.shingles import Powers, mixed

ship_by_value(__name__)

K = 8
HASHES = 32
TUPLE = 2
DIGITS = 8
OCCURRENCE = 0xD1B54A32D192ED03
SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
FLIPS = (SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32)
FACTORS = (SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
BLOCK = 1 << 21
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmers(text: bytes, powers: Powers) -> np.ndarray:
    """A hash of each k-mer of the UTF-8 bytes in text order; a shorter text is one k-mer."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    k = min(K, len(data))
    up, down = powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1] + np.uint64(k))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal k-mers come before each k-mer."""
    n = len(hashes)
    bits = np.uint64(max(1, n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    sorted_ = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    run = np.concatenate([[True], (sorted_[1:] >> bits) != (sorted_[:-1] >> bits)])
    first = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    out = np.empty(n, np.uint64)
    out[(sorted_ & low).astype(np.int64)] = np.arange(n) - first
    return out


def sketch(text: str, powers: Powers) -> np.ndarray:
    """The signature of a text: one 32-bit value for each hash function, none for no text.

    For each function the ``TUPLE`` k-mers with the smallest hashes are selected, where the
    second, third... occurrence of a k-mer counts as another k-mer; put back in the order they
    have in the text, they are hashed to one value.
    """
    grams = kmers(text.encode("utf-8", "surrogatepass"), powers)
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.uint32)
    items = (mixed(grams + occurrences(grams) * np.uint64(OCCURRENCE)) >> np.uint64(32)).astype(np.uint32)
    step = max(1, BLOCK // n)
    out = np.empty(HASHES, np.uint32)
    for lo in range(0, HASHES, step):
        ranks = (items ^ FLIPS[lo : lo + step, None]) * FACTORS[lo : lo + step, None]
        rows = np.arange(len(ranks))
        chosen = np.empty((len(ranks), min(TUPLE, n)), np.int64)
        for turn in range(chosen.shape[1]):
            at = ranks.argmin(axis=1)
            chosen[:, turn] = at
            ranks[rows, at] = 0xFFFFFFFF
        chosen.sort(axis=1)
        value = np.full(len(ranks), chosen.shape[1], np.uint64)
        for turn in range(chosen.shape[1]):
            value = mixed(value + grams[chosen[:, turn]])
        out[lo : lo + step] = value >> np.uint64(32)
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal values; texts without any are like each other alone."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``other``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + other[:quarter]


def compared(doc, text: str, own: np.ndarray, other: str, theirs: np.ndarray, powers: Powers) -> tuple:
    changed = edited(text, other)
    new = sketch(changed, powers)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, as_text(own), as_text(new), likeness(own, new), likeness(own, theirs)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; a null text is empty, and an empty text has
    the empty fingerprint. Equal texts have equal fingerprints. No shuffle; rows without an id
    and repeated rows are answered each; other columns are ignored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            marks = [as_text(sketch(t, powers)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(task, "doc_id long, n_chars long, fingerprint string")


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited text and the next document's, in ascending id order.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. After the last document comes the first; a lone document is its own next. Rows
    without an id come first, rows of one id go by their text. An empty table gives no rows.

    Texts are moved once, ranged by id; each task then streams over its range with one document
    held back. Only the first and the last document of each range cross to another range.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    streamed = pa.schema([*RESULT, ("shard", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, shard, held = Powers(), TaskContext.get().partitionId(), None
        for part in slices(batches, "text"):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = sketch(text, powers)
                if held is None:
                    out.append((doc, *[None] * 6, shard, "first", text))
                else:
                    out.append((*compared(*held, text, own, powers), None, None, None))
                held = (doc, text, own)
            yield arrow_rows(out, streamed)
        if held:
            yield arrow_rows([(held[0], *[None] * 6, shard, "last", held[1])], streamed)

    table = written(ordered.mapInArrow(stream, COLUMNS + ", shard int, edge string, text string"), "fingerprints")
    edges = table.filter("edge IS NOT NULL").select("doc_id", "shard", "edge", "text")
    shards = edges.filter("edge = 'first'").select("shard")
    order = Window.orderBy("shard")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = shards.select("shard", F.coalesce(F.lead("shard").over(order), F.min("shard").over(around)).alias("next"))
    first = edges.filter("edge = 'first'").select(F.col("shard").alias("next"), F.col("text").alias("other"))
    last = edges.filter("edge = 'last'").join(follows, "shard").join(first, "next").select("doc_id", "text", "other")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append(compared(r["doc_id"], r["text"], sketch(r["text"], powers), r["other"], sketch(r["other"], powers), powers))
            yield arrow_rows(out, RESULT)

    within = table.filter("edge IS NULL").select(*[f.name for f in RESULT])
    return within.unionByName(last.mapInArrow(across, COLUMNS))
