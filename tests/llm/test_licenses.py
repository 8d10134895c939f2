"""License scan: cases beyond the table, and the filters of the join."""

from __future__ import annotations

from trainlake.llm import licenses
from trainlake.llm.licenses import Template


def answered(spark, texts, templates=licenses.TEMPLATES):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, word string, row int")
    return {r.doc_id: r for r in licenses.scan_licenses(df, templates).collect()}


def test_cases(spark):
    texts = [
        None, "", "...", "Released Under The MIT\nLICENSE.", "under the mit", "the mit license under",
        "under the mit license; under-the-mit-license", "x " * 50_000 + "CC BY-NC 4.0 " + "y " * 50_000,
        "apache license version 20", "licensed under the Apache license, version 2.0",
        "Permission is granted, free of charge, to any person obtaining a copy of the software and associated documentation files, to deal in this software without restriction",
        "mit mit mit under under the license", "ünder the mit license", "İ under the mit license",
    ]
    got = answered(spark, texts)
    assert [got[k].n_base for k in range(len(texts))] == [0, 0, 0, 1, 0, 0, 2, 1, 0, 1, 0, 0, 0, 1]
    assert [got[k].n_words for k in range(7)] == [0, 0, 0, 5, 3, 4, 8]
    assert (got[6].first_word, got[6].last_word, got[6].base_labels, got[6].score) == (0, 4, "mit", 1.0)
    assert (got[7].first_word, got[7].labels) == (50_000, "cc-by-nc")
    assert got[10].base_labels == "" and got[10].labels == "mit" and 0.8 <= got[10].score < 1
    assert (got[0].first_word, got[0].labels, got[0].score) == (None, "", 0.0)
    assert got[13].first_word == 1
    assert answered(spark, []) == {}


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "under the mit license")] * 2 + [(None, "cc by nc")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_base) for r in licenses.scan_licenses(df).collect()), key=str) == [(1, 1), (1, 1), (None, 1)]


def test_prefixes_follow_the_frequencies():
    t = Template("x", "a b c d e", 0.6)
    counts = {"a": 5, "b": 1, "c": 9, "d": 1, "e": 7}
    assert licenses.needed(t) == 3
    assert licenses.prefix(t, counts) == ["b", "d", "a"]
    assert licenses.prefix(Template("x", "a b c", 1.0, True), counts) == ["b"]


def test_every_block_is_found(spark):
    """Random words: all blocks that share enough words with a template, by brute force."""
    import random

    rng = random.Random(0)
    templates = (Template("p", "a b c d", 0.75), Template("q", "a e f g h i", 0.5), Template("r", "c a", 1.0, True), Template("s", "a a b", 1.0, True))
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(0, 60))) for _ in range(150)]
    got = answered(spark, texts, templates)
    for k, text in enumerate(texts):
        words = text.split()
        labels, places, best = set(), [], 0.0
        for t in templates:
            for i in range(len(words)):
                block = words[i : i + len(t.words)]
                if t.base and block == t.words:
                    places.append(i)
                    labels.add(t.label)
                    best = 1.0
                shared = len(set(block) & set(t.words))
                if not t.base and shared >= licenses.needed(t):
                    labels.add(t.label)
                    best = max(best, shared / len(set(t.words)))
        assert got[k].labels == ",".join(sorted(labels)), text
        assert got[k].n_base == len(places) and got[k].score == best
        assert (got[k].first_word, got[k].last_word) == ((min(places), max(places)) if places else (None, None))
