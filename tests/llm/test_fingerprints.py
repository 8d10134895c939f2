"""Order MinHash fingerprints against a plain computation."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np

from trainlake.llm import fingerprints as fp
from trainlake.llm import queries
from trainlake.llm.shingles import Powers

SMALL_DIR = "/root/testdata/sf0.001"


def plain_sketch(text: str) -> list[int]:
    """The signature as its definition reads, one hash function and one k-mer at a time."""
    grams = [int(g) for g in fp.kmers(text.encode(), Powers())]
    seen: dict[int, int] = {}
    items = []
    for g in grams:
        items.append(int(fp.mixed(np.array([g + seen.get(g, 0) * fp.OCCURRENCE & (1 << 64) - 1], np.uint64))[0]) >> 32)
        seen[g] = seen.get(g, 0) + 1
    out = []
    for flip, factor in zip(fp.FLIPS.tolist(), fp.FACTORS.tolist(), strict=True):
        chosen = sorted(sorted(range(len(items)), key=lambda i: ((items[i] ^ flip) * factor & 0xFFFFFFFF, i))[: fp.TUPLE])
        value = len(chosen)
        for i in chosen:
            value = int(fp.mixed(np.array([value + grams[i] & (1 << 64) - 1], np.uint64))[0])
        out.append(value >> 32)
    return out if grams else []


def test_sketch():
    for text in ("", "a", "abcdefgh", "aaaaaaaaaaaaaaaaaa", "Ünï çødé 日本語 " * 5, "the quick brown fox jumps over the lazy dog"):
        assert fp.sketch(text, Powers()).tolist() == plain_sketch(text)


def test_long_text_in_blocks(monkeypatch):
    text = "one two three four five " * 50
    want = fp.sketch(text, Powers())
    monkeypatch.setattr(fp, "BLOCK", 100)
    assert (fp.sketch(text, Powers()) == want).all()


def test_order_matters():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(400)]
    text, turned = " ".join(words), " ".join(words[200:] + words[:200])
    signature = fp.sketch(text, Powers())
    assert fp.likeness(signature, fp.sketch(turned, Powers())) < 0.75
    assert fp.likeness(signature, fp.sketch(text, Powers())) == 1


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or ""))
    out = []
    for (doc, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        new = fp.edited(text, other)
        a, b, c = (fp.sketch(t, Powers()) for t in (text, new, other))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL_DIR}/documents.parquet'").fetchall()
    got = sorted(map(tuple, queries.QUERIES["op3_order_minhash"](spark, SMALL_DIR).collect()))
    assert got == expected(docs)
    near, far = (np.mean([r[k] for r in got if r[1] > 200]) for k in (5, 6))
    assert near > 0.25 > 0.05 > far


def test_edges(spark):
    schema = "doc_id long, text string, shard int, edge string"
    for docs in ([], [(5, "lone text of one row")], [(3, None), (1, ""), (2, "abc"), (2, "abc"), (2, "abd"), (9, "é" * 50)]):
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], schema)
        assert sorted(map(tuple, fp.edit_sensitivity(df).collect())) == sorted(expected(docs))
    df = spark.createDataFrame([(None, "no id", 1, ""), (None, None, 1, ""), (4, "four", 1, "")], schema)
    assert [r.n_chars for r in fp.edit_sensitivity(df).orderBy("n_chars").collect()] == [0, 4, 5]
    assert fp.fingerprint(df).count() == 3
