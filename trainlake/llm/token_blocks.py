"""Token ids in a compact block format: patched frame of reference.

A segment is a run of whole documents in ascending id order. Its ids are cut into blocks of 128
values. Of each block the minimum is subtracted; the rest is packed at the width that holds the
chosen share of the values (``PERCENTILE``); what is wider goes to the block's exception list.
The starts of all blocks are indexed, so one block can be read without the others: ``read_ids``.

Layout of a segment, little-endian, each array preceded by its length as uint32:

    magic "PFOR", count of ids uint64
    uint32 minimum of each block        uint8 width of each block
    uint32 start of each block (in words of 64 bits)
    uint32 first exception of each block (one more entry at the end)
    uint64 packed words                 uint8 place of each exception
    uint32 value of each exception, minimum subtracted
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value, shuffle_partitions, slices
from trainlake.llm.tokens import END_ID, WordEncoder, word_bpe_path
from trainlake.session import scratch_path

ship_by_value(__name__)

MAGIC = b"PFOR"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
KINDS = ("<u4", "u1", "<u4", "<u4", "<u8", "u1", "<u4")
SEGMENTS = "shard int, segment int, first_id long, start_in_shard long, n_ids long, n_docs long, doc_ids binary, doc_lengths binary, payload binary"


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of each value of an array below 2**32; 0 has none."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 2 * width words."""
    out = np.zeros((len(values), 2 * width), np.uint64)
    wide = values.astype(np.uint64)
    for lane in range(BLOCK):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= wide[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= wide[:, lane] >> np.uint64(64 - shift)
    return out


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(BLOCK):
        word, shift = divmod(lane * width, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = got & mask
    return out


def pack_ids(ids: np.ndarray) -> bytes:
    """The ids, unsigned and below 2**32, in the format above."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    values = padded.reshape(blocks, BLOCK)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = values - low[:, None]
    wanted = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))] if blocks else low
    widths = bit_length(wanted)
    starts = np.concatenate([[0], np.cumsum(2 * widths.astype(np.int64))])
    if starts[-1] >= 1 << 32:
        raise ValueError("segment too long for its block index")
    outlying = rest >> widths.astype(np.uint64)[:, None] > 0
    rows, places = np.nonzero(outlying)
    first = np.searchsorted(rows, np.arange(blocks + 1))
    exceptions = rest[rows, places]
    kept = np.where(outlying, 0, rest)
    packed = np.zeros(starts[-1], np.uint64)
    for width in np.unique(widths):
        if width:
            own = np.nonzero(widths == width)[0]
            packed[starts[own][:, None] + np.arange(2 * int(width))] = pack_lanes(kept[own], int(width))
    arrays = (low, widths, starts[:-1], first, packed, places, exceptions)
    out = [MAGIC, struct.pack("<Q", n)]
    for kind, values in zip(KINDS, arrays, strict=True):
        out += [struct.pack("<I", len(values)), values.astype(kind).tobytes()]
    return b"".join(out)


def unpack_ids(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a packed segment, or those from ``start`` to ``stop`` (exclusive): the block index
    says where their blocks lie, and only these are unpacked."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    (n,) = struct.unpack_from("<Q", payload, 4)
    at, arrays = 12, []
    for kind in KINDS:
        (size,) = struct.unpack_from("<I", payload, at)
        arrays.append(np.frombuffer(payload, kind, size, at + 4))
        at += 4 + size * np.dtype(kind).itemsize
    start, stop = max(0, start), n if stop is None else min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint32)
    some = slice(start // BLOCK, -(-stop // BLOCK))
    low, widths, starts, first, packed, places, exceptions = arrays
    low, widths, starts, first = low[some], widths[some], starts[some], first[some.start : some.stop + 1].astype(np.int64)
    values = np.zeros((len(low), BLOCK), np.uint32)
    for width in np.unique(widths):
        if width:
            own = np.nonzero(widths == width)[0]
            words = packed[starts[own].astype(np.int64)[:, None] + np.arange(2 * int(width))]
            values[own] = unpack_lanes(words, int(width))
    rows = np.repeat(np.arange(len(low)), np.diff(first))
    values[rows, places[first[0] : first[-1]]] = exceptions[first[0] : first[-1]]
    skipped = some.start * BLOCK
    return (values + low[:, None]).reshape(-1)[start - skipped : stop - skipped]


def write_token_blocks(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
) -> None:
    """Encode the whole texts and write them as segments in ascending id order to ``path``.

    Rows are ranged by id, so that shard follows shard; a shard streams through its task, which
    closes a segment at the first document end after ``SEGMENT_IDS`` ids. A null text is empty
    and leaves the end id. Rows without an id come first; repeated rows are written each, in an
    order given by their text. An empty table gives no segments; other columns are ignored.
    """
    encoder_path = tokenizer or word_bpe_path()
    names = [f.split()[0] for f in SEGMENTS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(encoder_path)
        shard = TaskContext.get().partitionId()
        segment = before = size = 0
        parts: list[np.ndarray] = []
        docs_in: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, before, size
            known = np.array([-1 if d is None else d for d in docs_in], "<i8")
            missing = np.packbits(np.array([d is None for d in docs_in])).tobytes()
            row = (shard, segment, docs_in[0], before, size, len(docs_in), known.tobytes() + missing, np.array(lengths, "<i8").tobytes(), pack_ids(np.concatenate(parts)))
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3)
            batch = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            segment, before, size = segment + 1, before + size, 0
            for held in (parts, docs_in, lengths):
                held.clear()
            return batch

        for part in slices(batches, "text"):
            ids, ends = encoder.encode(part.column("text"), END_ID)
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                own = ids[ends[k] : ends[k + 1]]
                parts.append(own)
                docs_in.append(doc)
                lengths.append(len(own))
                size += len(own)
                if size >= SEGMENT_IDS:
                    yield close()
        if docs_in:
            yield close()

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(task, SEGMENTS).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """The documents of written segments: ``doc_id, start, n_tokens, ids``. ``start`` counts the
    ids of all documents before; the sums of the shards that it needs are one row per shard.

    With ``checksums`` there is ``ids_crc32`` instead of ``ids``, the unsigned crc32 of the read
    ids in little-endian order, four bytes each; then no ids leave the Python workers."""
    rows = located(spark.read.schema(SEGMENTS).parquet(path)).select("start", "n_docs", "doc_ids", "doc_lengths", "payload")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                docs = np.frombuffer(row["doc_ids"], "<i8", n)
                missing = np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8, offset=8 * n), count=n).astype(bool)
                lengths = np.frombuffer(row["doc_lengths"], "<i8", n)
                ids = unpack_ids(row["payload"])
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    if checksums:
                        last = pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[lo:hi], ends[lo + 1 : hi + 1], strict=True)], pa.int64())
                    else:
                        bounds = pa.array(ends[lo : hi + 1] - ends[lo], pa.int32())
                        last = pa.ListArray.from_arrays(bounds, pa.array(ids[ends[lo] : ends[hi]].astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], pa.int64(), mask=missing[lo:hi]),
                            pa.array(row["start"] + ends[lo:hi], pa.int64()),
                            pa.array(lengths[lo:hi], pa.int64()),
                            last,
                        ],
                        names=["doc_id", "start", "n_tokens", name],
                    )

    name = "ids_crc32" if checksums else "ids"
    return rows.mapInArrow(task, f"doc_id long, start long, n_tokens long, {name} {'long' if checksums else 'array<int>'}")


def located(segments: DataFrame) -> DataFrame:
    """Segments with ``start``, the ids of all segments before; one row per shard is summed up."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return segments.join(F.broadcast(offsets), "shard").withColumn("start", F.col("shard_start") + F.col("start_in_shard"))


def read_ids(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The ids ``start`` to ``start + length`` of the whole file, counted from 0, in pieces
    ``start, ids`` of one segment each. Segments are found by their sizes; of others nothing is read,
    and of theirs the blocks in the range alone are unpacked. What lies beyond the end is left out."""
    stop = start + length
    slim = located(spark.read.schema(SEGMENTS).parquet(path).select("shard", "segment", "start_in_shard", "n_ids"))
    met = slim.filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    ends = met.agg(F.min(F.struct("shard", "segment", "start")).alias("low"), F.max(F.struct("shard", "segment")).alias("high")).first()
    if length <= 0 or ends.low is None:
        return spark.createDataFrame([], "start long, ids array<int>")
    low, high = ends.low, ends.high
    wanted = f"(shard > {low.shard} OR shard = {low.shard} AND segment >= {low.segment}) AND (shard < {high.shard} OR shard = {high.shard} AND segment <= {high.segment})"
    # The range is one run of segments, so numbers say which rows to read.
    payloads = spark.read.schema(SEGMENTS).parquet(path).filter(f"shard BETWEEN {low.shard} AND {high.shard}").filter(wanted).select("shard", "segment", "payload")
    rows = payloads.join(F.broadcast(met.select("shard", "segment", "start")), ["shard", "segment"]) if low[:2] != high else payloads.withColumn("start", F.lit(low.start))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["start", "payload"]).to_pylist():
                own = unpack_ids(r["payload"], start - r["start"], stop - r["start"])
                first = max(start, r["start"])
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([own.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return rows.select("start", "payload").mapInArrow(task, "start long, ids array<int>")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents as token blocks in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path)
    return read_token_blocks(docs.sparkSession, path, checksums=True)
