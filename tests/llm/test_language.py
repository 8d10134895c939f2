"""Language identification: held-out accuracy, its parts against plain code, and edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trainlake.llm import language, queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet' WHERE n_chars >= 40").fetchall())
    rows = queries.QUERIES["op10_language_id"](spark, SF_DIR).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_grams_and_vectors():
    settings = language.Settings(bits=10)
    texts = ["Été à 3 pays!", "", "1234", "aba aba", "İx 日本", None]
    got = list(language.Grams(settings).features(pa.array(texts).fill_null("")))
    assert [ok for _, ok in got] == [True, False, False, True, True, False]

    def plain(text):
        symbols, last = [], False
        for c in text:
            if c.isalpha():
                symbols.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
            elif last:
                symbols.append(32)
            last = c.isalpha()
        out = []
        for n in (1, 2, 3):
            for i in range(len(symbols) - n + 1):
                v = 0
                for s in symbols[i : i + n]:
                    v = (v * 0x110001 + s) & (1 << 64) - 1
                out.append(((v + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 54)
        return Counter(out)

    for text, (buckets, _) in zip(texts, got, strict=True):
        assert Counter(buckets.tolist()) == plain(text or "")
    idf = np.linspace(1, 2, 1 << 10)
    at, x = language.vector(got[0][0], idf)
    assert at[-1] == 1 << 10 and x[-1] == 1 and (x[:-1] ** 2).sum() == pytest.approx(1)


def test_follow_the_regularised_leader():
    """Against the textbook update, one coordinate at a time; a large l1 leaves zeros."""
    settings = language.Settings(l1=0.3)
    rng = np.random.default_rng(0)
    learner = language.Ftrl(6, 3, settings)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(40):
        at = np.sort(rng.choice(6, 3, replace=False))
        x, label = rng.random(3), int(rng.integers(3))
        w = np.zeros((6, 3))
        for i in range(6):
            for k in range(3):
                if abs(z[i, k]) > settings.l1:
                    w[i, k] = -(z[i, k] - math.copysign(settings.l1, z[i, k])) / ((settings.beta + math.sqrt(n[i, k])) / settings.alpha + settings.l2)
        e = np.exp([sum(x[j] * w[i, k] for j, i in enumerate(at)) for k in range(3)])
        p = e / e.sum()
        for j, i in enumerate(at):
            for k in range(3):
                g = (p[k] - (k == label)) * x[j]
                sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / settings.alpha
                z[i, k] += g - sigma * w[i, k]
                n[i, k] += g * g
        learner.learn(at, x, label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
    assert (learner.weights() == 0).any() and (learner.weights() != 0).any()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "12 34", None, 1), (None, "the dog", "en", 1), (102, "", "de", 1), (103, "the dog " * 20000, None, 1), (103, "the dog " * 20000, None, 1)]
    got = language.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 100, 101, 102, 103, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert by[100].score == 0 and by[None].held_out
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    unlabelled = language.identify(spark.createDataFrame([(1, "abc", None, 1)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    with pytest.raises(ValueError, match="lang_pred"):
        language.predict(spark.createDataFrame(rows, schema), language.Model(language.Settings()))


def test_sample_bounds(spark):
    from pyspark.sql import functions as F

    ranks = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"), F.xxhash64("id").alias("rank"))
    want = {}
    for r in ranks.collect():
        want.setdefault(r.lang, []).append(r.rank)
    assert language.sample_bounds(ranks, {k: len(v) for k, v in want.items()}, 200) == {k: sorted(v)[199] for k, v in want.items()}
    assert language.sample_bounds(ranks, {k: len(v) for k, v in want.items()}, 5000) == {"de": max(want["de"]), "en": sorted(want["en"])[4999]}
