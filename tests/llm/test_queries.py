"""Registered queries over whole tables against their SQL or a plain computation in Python."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from compare import connect, difference

from trainlake.llm import licenses, queries, tokens

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def rows(table: str, columns: str, order: str, sf_dir: str = SMALL_DIR) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet' ORDER BY {order}").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name]) is None


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_bpe_path())
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows("documents", "doc_id, text", "doc_id")}


def crc(ids) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_blocks(spark, encoded):
    want, start = {}, 0
    for doc, ids in sorted(encoded.items()):
        want[doc] = (start, len(ids), crc(ids))
        start += len(ids)
    have = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_token_blocks"](spark, SMALL_DIR).collect()}
    assert have == want


def test_packing(spark, encoded):
    pieces = queries.QUERIES["op7_packing"](spark, SMALL_DIR).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(encoded)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(encoded[doc])
            assert p.ids_crc32 == crc(encoded[doc][at : at + p.length])
            at += p.length
        assert at == len(encoded[doc])
    unfilled = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and len(own) <= 512
        unfilled += at < 4096
    assert unfilled <= 2


def test_license_scan(spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    have = {r.doc_id: r for r in queries.QUERIES["op5_license_scan"](spark, SF_DIR).collect()}
    found = 0
    for doc, text in rows("documents", "doc_id, text", "doc_id", SF_DIR):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(licenses.WORD, lowered)
        places = [(i, label) for label, phrase in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = have.pop(doc)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        best, labels = 0.0, {label for _, label in places}
        for t in licenses.TEMPLATES:
            for i in range(len(words)):
                shared = len(set(words[i : i + len(t.words)]) & set(t.words))
                if shared >= licenses.needed(t) and not t.base:
                    best = max(best, shared / len(set(t.words)))
                    labels.add(t.label)
        assert r.labels == ",".join(sorted(labels))
        assert r.score == pytest.approx(1.0 if places else best)
        found += bool(labels)
    assert not have and found > 10
