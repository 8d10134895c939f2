"""Benchmark decontamination against a plain search."""

from __future__ import annotations

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trainlake.llm import contamination as ct
from trainlake.llm import queries
from trainlake.llm.shingles import Powers

SMALL_DIR = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    """Hit places and item ids by comparing every window with every place."""
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        size = min(window, len(theirs))
        for s in range(len(theirs) - size + 1 if size else 0):
            for q in range(len(own) - size + 1):
                if own[q : q + size] == theirs[s : s + size]:
                    hit.update(range(q, q + size))
                    found.add(item)
    return len(own), hit, found


def indexed(docs, items, window=10):
    """The same by a set of windows, for larger tables."""
    index = {}
    for item, text in items:
        theirs = words(text)
        size = min(window, len(theirs))
        for s in range(len(theirs) - size + 1 if size else 0):
            index.setdefault(tuple(theirs[s : s + size]), set()).add(item)
    sizes = {len(w) for w in index}
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for q in range(len(own) - size + 1):
                met = index.get(tuple(own[q : q + size]))
                if met:
                    hit.update(range(q, q + size))
                    found |= met
        yield doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def random_text(rng, n, letters="abcd"):
    return " ".join(rng.choice(letters) for _ in range(n))


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def result(found):
    return sorted((r.doc_id is not None, r.doc_id, r.n_words, sorted((x.first, x.end) for x in r.runs), sorted(r["items"], key=str)) for r in found.collect())


def expected(docs, items, window=10):
    out = []
    for doc, text in docs:
        n, hit, found = plain(text, items, window)
        runs = [q for q in sorted(hit) if q - 1 not in hit]
        ends = [q + 1 for q in sorted(hit) if q + 1 not in hit]
        out.append((doc is not None, doc, n, list(zip(runs, ends, strict=True)), sorted({None if i is None else str(i) for i in found}, key=str)))
    return sorted(out)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query(spark, name):
    folder = f"/root/testdata/{name}"
    if not os.path.isdir(folder):
        pytest.skip("test tables are absent")
    read = lambda t, c: duckdb.sql(f"SELECT {c} FROM '{folder}/{t}.parquet'").fetchall()
    want = sorted(indexed(read("documents", "doc_id, text"), read("benchmark", "item_id, text")))
    have = queries.QUERIES["op11_decontamination"](spark, folder)
    have = sorted(tuple(r) for r in have.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert have == want and sum(r[-1] for r in want) > 0


def test_few_letters(spark):
    """Texts over four words, where windows overlap and repeat everywhere."""
    rng = random.Random(5)
    items = [(k, random_text(rng, n, "ab")) for k, n in enumerate([1, 3, 9, 10, 11, 14, 25])]
    items += [(7, "x y z a b"), (8, "x y z a b"), (8, "B, b; b"), (9, None), (10, " .. "), (None, "q q q")]
    docs = [(k, random_text(rng, n, "abc")) for k, n in enumerate([0, 1, 2, 9, 10, 30, 200, 200])]
    docs += [(8, None), (9, "a b x. Y z A b"), (9, "q q q q"), (None, "b b b"), (None, "b b b"), (9, "a b x. Y z A b"), (10, "x y z a"), (11, "a" * 70000 + " x y z a b")]
    d, i = frames(spark, docs, items)
    assert result(ct.find_contamination(d, i, window=4)) == expected(docs, items, 4)
    assert result(ct.find_contamination(d, i)) == expected(docs, items)


def test_blocks_of_items(spark):
    """Several blocks give what one gives."""
    rng = random.Random(6)
    items = [(k, random_text(rng, rng.randrange(1, 30))) for k in range(30)]
    docs = [(k, random_text(rng, rng.randrange(60))) for k in range(20)] * 2
    d, i = frames(spark, docs, items)
    assert result(ct.find_contamination(d, i, window=3, block_bytes=150)) == expected(docs, items, 3)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b")])
    assert result(ct.find_contamination(d, i.limit(0))) == [(True, 1, 3, [], [])]
    assert ct.find_contamination(d.limit(0), i).collect() == []
    assert ct.decontaminate(d, i.limit(0)).count() == 1
    assert ct.longest_matches(d, i.limit(0)).collect() == []


def test_columns_stay(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, 'x a b c d', 'p', 1), (1, 'clean', 'q', 2), (2, NULL, 'r', 3), (NULL, 'a B', 's', 4) t(doc_id, text, digest, runs)")
    items = spark.sql("SELECT 'i1' AS item_id, 'a b' AS text, 7 AS doc_id, 1 AS digest")
    have = ct.decontaminate(docs, items)
    assert have.columns == docs.columns
    assert sorted(r.digest for r in have.collect()) == ["q", "r"]


def test_suffix_array_and_longest():
    """The array is in the order of the word sequences, and every longest match is right."""
    rng = random.Random(7)
    for turn in range(6):
        letters = "abcdefgh"[: 2 + turn]
        items = [random_text(rng, rng.randrange(1, 40), letters) for _ in range(6)]
        texts = [random_text(rng, rng.randrange(0, 80), letters + "z") for _ in range(9)] + ["", "z", items[0] + " z " + items[0]]
        test = ct.TestSuffixes(list(map(str, range(6))), pa.array(items), 10)
        shard = ct.Shard(pa.array(texts), test, Powers())
        flat = [w for t in texts for w in [*t.split(), ""]]
        known = {w for t in items for w in t.split()}

        def suffix(place, flat=flat, known=known):
            out = []
            while flat[place] in known and len(out) < test.longest:
                out.append(flat[place])
                place += 1
            return out

        # Word numbers go by hash, so order is that of the numbers.
        vocabulary = {int(h): k for k, h in enumerate(test.vocabulary)}
        number = {w: vocabulary[int(ct.word_hashes(pa.array([w]), Powers(), ct.WORD_BYTES)[0][0])] for w in known}
        keys = [[number[w] for w in suffix(p)] for p in shard.array.tolist()]
        assert sorted(keys) == keys and len(keys) == sum(w in known for w in flat)
        length, place = shard.longest()
        for s in range(len(test.places)):
            own = items[test.item[s]].split()[test.start[s] :]
            share = lambda q: next((k for k, (x, y) in enumerate(zip(own, [*flat[q:], None])) if x != y), len(own))  # noqa: E731, B023
            best = max(share(q) for q in range(len(flat)))
            assert length[s] == best and (best == 0 or share(place[s]) == best)


def test_longest_matches(spark):
    rng = random.Random(8)
    passage = random_text(rng, 30, "abcdefghijklmnop")
    own = passage.split()
    docs = [(1, "x " + " ".join(own[:12]) + " y"), (2, "z z " + " ".join(own[3:28])), (3, " ".join(own[3:28])), (4, None), (None, "a")]
    d, i = frames(spark, docs, [(5, passage)])
    have = {r.item_start: (r.n_words, r.doc_id, r.doc_start) for r in ct.longest_matches(d, i).collect()}
    assert have[0] == (12, 1, 1) and have[3] == (25, 2, 2) and have[10] == (18, 2, 9)
    assert set(have) == set(range(19))


def test_long_words_have_digests():
    """Thue-Morse words agree in every polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, _ = ct.word_hashes(pa.array([word, other]), Powers())
    assert len(np.unique(hashes)) == 2
