"""The block format: round trips, its index and exceptions, and documents in and out."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trainlake.llm import token_blocks as tb
from trainlake.llm.tokens import word_bpe_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 49_000), st.integers(0, 2**32 - 1)), max_size=600))
def test_round_trip(values):
    ids = np.array(values, np.uint32)
    assert tb.unpack_ids(tb.pack_ids(ids)).tolist() == values


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_sizes(n):
    for ids in (np.zeros(n, np.uint32), np.full(n, 2**32 - 1, np.uint32), np.arange(n, dtype=np.uint32)):
        assert (tb.unpack_ids(tb.pack_ids(ids)) == ids).all()


def test_widths_and_exceptions():
    """A block of small values with a few large ones is packed at the small width."""
    ids = np.full(128, 7, np.uint32)
    ids[::2] = 10
    ids[5], ids[90] = 40_000, 50_000
    payload = tb.pack_ids(ids)
    at, arrays = 12, []
    for kind in tb.KINDS:
        (size,) = struct.unpack_from("<I", payload, at)
        arrays.append(np.frombuffer(payload, kind, size, at + 4))
        at += 4 + size * np.dtype(kind).itemsize
    low, widths, starts, first, packed, places, exceptions = arrays
    assert low.tolist() == [7] and widths.tolist() == [2] and starts.tolist() == [0]
    assert first.tolist() == [0, 2] and len(packed) == 4
    assert places.tolist() == [5, 90] and exceptions.tolist() == [40_000 - 7, 50_000 - 7]
    with pytest.raises(ValueError, match="not a segment"):
        tb.unpack_ids(b"XXXX" + payload[4:])


def test_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "SEGMENT_IDS", 50)
    encode = Tokenizer.from_file(word_bpe_path()).encode
    docs = [(5, "five five", 1), (2, None, 1), (None, "no id", 1), (9, "", 1), (7, "word " * 300, 1), (5, "five five", 1), (-3, "minus", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int")
    tb.write_token_blocks(df, str(tmp_path / "t"))
    got = sorted(map(tuple, tb.read_token_blocks(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    start = 0
    for (doc, text, _), row in zip(order, got, strict=True):
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        assert row == (doc, start, len(ids), ids)
        start += len(ids)
    assert tb.round_trip(df.limit(0)).count() == 0


def test_parts_of_a_segment():
    """Any range of ids equals that of the whole, and only its blocks are unpacked."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49_000, 5000).astype(np.uint32)
    ids[rng.integers(0, 5000, 40)] = (1 << 32) - 1
    payload = tb.pack_ids(ids)
    for start, stop in [(0, 5000), (0, 1), (127, 129), (128, 256), (4999, 5000), (4000, 9000), (10, 10), (20, 5), *rng.integers(0, 5001, (60, 2)).tolist()]:
        assert tb.unpack_ids(payload, start, stop).tolist() == ids[start:stop].tolist()
    unpacked = []
    lanes = tb.unpack_lanes
    tb.unpack_lanes = lambda words, width: unpacked.append(len(words)) or lanes(words, width)
    try:
        tb.unpack_ids(payload, 300, 400)
    finally:
        tb.unpack_lanes = lanes
    assert sum(unpacked) == 2


def test_read_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "SEGMENT_IDS", 300)
    docs = spark.createDataFrame([(k, "some words of text number " * (k % 7) + str(k)) for k in range(120)], "doc_id long, text string")
    path = str(tmp_path / "blocks")
    tb.write_token_blocks(docs, path)
    whole = [i for r in tb.read_token_blocks(spark, path).orderBy("start").collect() for i in r.ids]
    assert spark.read.parquet(path).count() > 5
    for start, length in [(0, len(whole)), (0, 1), (290, 20), (700, 1500), (len(whole) - 3, 50), (len(whole), 5), (5, 0)]:
        got = [i for r in sorted(tb.read_ids(spark, path, start, length).collect()) for i in r.ids]
        assert got == whole[start : start + length]
    assert tb.read_ids(spark, path, 0, 10).count() == 1
