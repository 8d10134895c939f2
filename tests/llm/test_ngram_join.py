"""The n-gram join against all pairs in Python."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trainlake.llm import components, ngram_join
from trainlake.llm.ngram_join import Tree, bitmap, surviving

SMALL_DIR = "/root/testdata/sf0.001"


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def answered(spark, docs, percent: int = 75):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, percent).collect()}


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    return [rng.choice("uvwxyz") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.fixture
def hostile():
    """A group of near copies at the edge of the similarity, a passage in half of the texts,
    copies, short texts, case and blanks."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts: list[str | None] = [None, "", " \n", "A b C", "a B c", "a b c d", "one", "one", " ".join(base), " ".join(base).upper()]
    texts += [" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05]))) for _ in range(70)]
    texts += [" ".join([word() for _ in range(rng.randrange(10, 80))] + passage) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    return list(enumerate(texts, 100))


def test_all_links_are_found(spark, hostile):
    assert answered(spark, hostile) == expected(hostile)


def test_without_the_first_comparison(spark, hostile, monkeypatch):
    """With no components beforehand, the trees alone lead to the same links."""
    calls = []

    def nothing_at_first(links):
        calls.append(1)
        return components.connected_components(links.limit(0) if len(calls) == 1 else links)

    monkeypatch.setattr(ngram_join, "connected_components", nothing_at_first)
    monkeypatch.setattr(ngram_join, "TREE", 16)
    assert answered(spark, hostile, 60) == expected(hostile, 60)


def test_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL_DIR}/documents.parquet'").fetchall()
    want = expected(docs)
    assert answered(spark, docs) == want
    assert sum(d != c for d, (_, c) in want.items()) > 5


def test_empty_and_missing(spark):
    assert answered(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (4, "a b c d e f", 3), (4, "a b c d e f", 3), (2, "a  b c d e F", 3)], "doc_id long, text string, token int")
    got = sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2)], key=str)


def test_tree_drops_no_link():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = sorted((np.unique(rng.choice(pool[: rng.integers(80, 400)], rng.integers(60, 90))) for _ in range(300)), key=len)
    words = min(len(bitmap(s)) for s in sets)
    n = np.array([len(s) for s in sets])
    tree = Tree(n, np.arange(300), np.stack([ngram_join.folded(bitmap(s), words) for s in sets]))
    got = set(zip(*(x.tolist() for x in surviving(tree, tree, True, 40)), strict=True))
    links = {(i, j) for i in range(300) for j in range(i + 1, 300) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 40 * (n[i] + n[j] - c)}
    assert links and links <= got
    assert len(got) < 300 * 299 / 2


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(25)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {v: v for link in links for v in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in link and link[0] != link[1] for link in links)}


def test_one_id_with_two_texts(spark):
    """The pair is compared with each text of the id, also where only the second one links."""
    one, two = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    texts = pa.table({"doc_id": [2, 5, 5], "text": [" ".join([*two, "x"]), " ".join(one), " ".join(two)]})
    for rows in (texts, texts.take([0, 2, 1])):
        docs = spark.createDataFrame(rows).coalesce(1)
        pairs = ngram_join.written(spark.createDataFrame([(2, 5)], "a long, b long"), "pairs")
        assert ngram_join.linked(pairs, docs, 75).count() == 1


def test_bitmaps_never_lose_a_link():
    """The bound of the bitmaps is at least the overlap, and far below it for sets with little in common."""
    rng = np.random.default_rng(9)
    for n, m, common in [(1, 1, 1), (5, 9, 5), (300, 280, 270), (300, 300, 0), (1000, 700, 690), (2000, 1500, 150), (64, 65, 1)]:
        values = rng.integers(0, 1 << 63, n + m - common, dtype=np.int64).astype(np.uint64)
        x, y = values[:n], values[n - common :]
        for bits in (2, 8):
            most = ngram_join.overlap_bound(ngram_join.bitmap(x, bits), n, ngram_join.bitmap(y, bits), m)
            assert common <= most <= min(n, m)
    x, y = rng.integers(0, 1 << 63, (2, 1000), dtype=np.int64).astype(np.uint64)
    assert 175 * ngram_join.overlap_bound(ngram_join.bitmap(x, 2), 1000, ngram_join.bitmap(y, 2), 1000) < 75 * 2000


def test_a_shared_passage_is_no_likely_pair(spark):
    """Texts that share a passage meet in its lists, and part before their texts are moved."""
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(d, f"{passage} " + " ".join(f"d{d}w{k}" for k in range(160))) for d in range(30)] + [(100, f"{passage} " + " ".join(f"d3w{k}" for k in range(158)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in [*range(a + 1, 30), 100]], "a long, b long")
    found = {(r.a, r.b) for r in ngram_join.possible_pairs(pairs, df, 75).collect()}
    assert found == {(3, 100)}


def test_the_most_frequent_shingles_come_last(spark):
    """A set of frequent shingles alone is listed by the least frequent of them."""
    common = [f"c{k}" for k in range(30)]
    docs = [(d, " ".join([*common, *[f"t{d // 2}w{k}" for k in range(120)], f"e{d}"])) for d in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    frequent = ngram_join.frequent_shingles(ngram_join.shingle_rows(df))
    tokens, steps = frequent
    assert len(tokens) == len(np.unique(tokens)) and (np.sort(tokens) == tokens).all()
    often = set(tokens[steps == steps.max()].tolist())
    assert len(often) == 26
    listed = ngram_join.postings(df, frequent, 75).collect()
    assert listed and not any(r.token % 2**64 in often for r in listed)


def test_prefix_is_in_one_order():
    """Rare shingles first, then frequent ones by step; the same order for all sets."""
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64))
    tokens = np.sort(rng.choice(pool, 200, replace=False))
    frequent = tokens, rng.integers(8, 40, 200).astype(np.int16)
    place = {t: (0, t) for t in pool.tolist()} | {t: (s, t) for t, s in zip(tokens.tolist(), frequent[1].tolist(), strict=True)}
    for _ in range(20):
        own = np.sort(rng.choice(pool, 90, replace=False))
        for take in (1, 23, 60, 90):
            assert ngram_join.prefix(own, take, frequent).tolist() == sorted(own.tolist(), key=place.get)[:take]
    assert ngram_join.prefix(own, 5, (tokens[:0], frequent[1][:0])).tolist() == own[:5].tolist()
