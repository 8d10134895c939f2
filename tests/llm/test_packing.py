"""Packing under several limits, without and with Spark."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trainlake.llm.packing import Limits, Packer, Piece, pack
from trainlake.llm.tokens import word_bpe_path


def packed(documents, limits):
    sequences = []
    packer = Packer(limits, lambda pieces: sequences.append([(p.doc, p.start, p.ids.tolist(), p.offset, p.loss) for p in pieces]))
    for k, (ids, loss_from) in enumerate(documents):
        packer.add(Piece(k, 0, np.array(ids, np.uint32), len(ids), loss_from))
    packer.finish()
    return sequences


@pytest.mark.parametrize("limits", [Limits(64, 8, 64, 4), Limits(64, 3, 64, 4), Limits(64, 8, 20, 4), Limits(1, 1, 1, 1), Limits(64, 1, 64, 2)])
def test_limits_hold_and_nothing_is_lost(limits):
    rng = np.random.default_rng(1)
    documents = [(rng.integers(0, 1000, rng.integers(1, 150)).tolist(), int(rng.integers(0, 100))) for _ in range(200)]
    sequences = packed(documents, limits)
    whole = defaultdict(list)
    for sequence in sequences:
        at = loss = 0
        for doc, start, ids, offset, bearing in sequence:
            assert offset == at and ids
            at += len(ids)
            loss += bearing
            assert bearing == sum(i >= documents[doc][1] for i in range(start, start + len(ids)))
            whole[doc].append((start, ids))
        assert at <= limits.tokens and len(sequence) <= limits.segments and loss <= limits.loss
    for doc, (ids, _) in enumerate(documents):
        assert [i for _, part in sorted(whole[doc]) for i in part] == ids


def test_little_padding():
    rng = np.random.default_rng(2)
    documents = [([1] * int(n), 0) for n in rng.integers(1, 3000, 500)]
    sequences = packed(documents, Limits())
    used = [sum(len(ids) for _, _, ids, _, _ in s) for s in sequences]
    assert sum(n < 4096 for n in used) <= 1


def test_dot_product_choice():
    """A piece rich in loss goes where loss has room, not where tokens have."""
    limits = Limits(100, 10, 50, 3)
    packer = Packer(limits, lambda pieces: None)
    for n, loss_from in ((60, 15), (70, 70), (20, 0)):
        packer.add(Piece(n, 0, np.zeros(n, np.uint32), n, loss_from))
    assert [[p.doc for p in b] for b in packer.bins] == [[60], [70, 20]]


def test_rows(spark):
    encode = Tokenizer.from_file(word_bpe_path()).encode
    docs = [(1, "one two three", 2, "x"), (None, None, None, "x"), (3, "", 0, "x"), (1, "one two three", 2, "x"), (4, "word " * 9000, 100, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, from long, offset string").repartition(2)
    got = pack(df, loss_from_col="from").collect()
    n = len(encode("word " * 9000, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got if r.doc_id == 4) == n and sum(r.loss_tokens for r in got if r.doc_id == 4) == n - 100
    assert sorted((r.length, r.loss_tokens) for r in got if r.doc_id == 1) == [(4, 2), (4, 2)]
    assert sorted(r.doc_tokens for r in got if r.doc_id in (None, 3)) == [1, 1]
    assert pack(df.limit(0), loss_from_col="from").count() == 0
