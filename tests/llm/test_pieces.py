"""The relational lattice against the library and a plain search over all segmentations."""

from __future__ import annotations

import random
import zlib
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trainlake.llm import pieces, queries
from trainlake.llm.shingles import mixed

SMALL_DIR = "/root/testdata/sf0.001"
MODEL = open(pieces.piece_model_path(), "rb").read()
#: The file as it is (merges), and read as a unigram model: type 1 in its trainer settings. Its
#: list of best paths is exact; its one-path encoder misses the best sum for a few words.
MERGING = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
UNIGRAM = sentencepiece.SentencePieceProcessor(model_proto=MODEL + b"\x12\x02\x18\x01")
VOCAB = pieces.vocabulary()
ODD = ["", None, "a", "Hello world", " lead", "a  b   c    d", "trail  ", "\n", "x\ny\n\nz", "tab\there\r\n", "日本語é🙂 x", "aaaaaaaaaaaaaaaaaaaaaaaa", "The  quick\n brown", "▁ a", "\x00\x7f", "don't (stop);\r"]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "w", 1) for k, t in enumerate(texts)], "doc_id long, text string, word string, row int")


@cache
def word_ids(word: str, algorithm: str) -> tuple[int, ...]:
    """The library's ids of one word; its dummy blank is the word's own first one."""
    if algorithm == "merged":
        return tuple(pieces.long_merge(word, VOCAB))
    return tuple(pieces.long_viterbi(word, VOCAB))


def test_words():
    assert pieces.words_of("One, two\n(three) it's  x”. 3.5") == ["▁One", ",", "▁two", "\n", "(", "three", ")", "▁it", "'", "s", "▁▁x”.", "▁3", ".", "5"]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("aB1é.,-( \n\t日”▁_", k=rng.randrange(1, 30)))
        words = pieces.words_of(text)
        assert "".join(words) == "▁" + text.replace(" ", "▁")
        assert [i for w in words for i in pieces.long_merge(w, VOCAB)] == MERGING.encode(text), text


def test_folds_in_python():
    rng = random.Random(0)
    words = [w for t in ODD if t for w in pieces.words_of(t)]
    words += ["▁" + "".join(rng.choices("abehorst,.é日", k=rng.randrange(1, 30))) for _ in range(400)]
    for word in words:
        if word[0] == "▁" and word[1:2] != "▁":
            text = word[1:].replace("▁", " ")
            if text and pieces.words_of(text) == [word]:
                assert pieces.long_merge(word, VOCAB) == MERGING.encode(text), word
                ours = pieces.long_viterbi(word, VOCAB)
                assert UNIGRAM.decode(ours) == text
                if all(c in VOCAB.ids for c in word):
                    theirs = max(sum(VOCAB.scores[i] for i in ids) for ids in UNIGRAM.nbest_encode_as_ids(text, 4))
                    assert sum(VOCAB.scores[i] for i in ours) == theirs, word


def test_lattice_folds(spark):
    rng = random.Random(1)
    words = ["▁" * n for n in (1, 2, 3, 7, 16)] + ["\n", "▁x", "日本", "▁🙂é"]
    words += ["▁" + "".join(rng.choices("abehorst,.é日", k=rng.randrange(1, 59))) for _ in range(120)]
    words += ["▁" + "ab" * 40, "z" * 61, "z" * 60]
    df = spark.createDataFrame([(w, 1) for w in dict.fromkeys(words)], "word string, n long").repartition(4, "word")
    got = {r.word: r for r in pieces.encode_words(df, VOCAB).collect()}
    assert set(got) == set(words)
    for w in words:
        assert tuple(got[w].merged) == word_ids(w, "merged"), w
        assert tuple(got[w].viterbi) == word_ids(w, "viterbi"), w


def test_viterbi_is_the_best_of_all():
    def best(word):
        if not word:
            return 0.0
        out = -np.inf
        for end in range(1, len(word) + 1):
            score = VOCAB.scores[VOCAB.ids[word[:end]]] if word[:end] in VOCAB.ids else VOCAB.unknown_score if end == 1 else None
            if score is not None:
                out = max(out, score + best(word[end:]))
        return out

    for word in ("▁hello", "▁tion", "thereof", "▁andby", "estionan"):
        ids = pieces.long_viterbi(word, VOCAB)
        assert sum(VOCAB.scores[i] for i in ids) == best(word)


def test_encode_and_decode(spark):
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL_DIR}/documents.parquet' ORDER BY doc_id LIMIT 40").fetchall()] + ODD
    df = pieces.encode(table(spark, docs))
    got = {r.doc_id: r.ids for r in df.collect()}
    for k, text in enumerate(docs):
        assert got[k] == MERGING.encode(text or ""), text
    back = pieces.decode(df, VOCAB, "doc_id").select("doc_id", pieces.plain_text(F.col("text")).alias("text"))
    for r in back.collect():
        assert r.text == (docs[r.doc_id] or "").replace("▁", " ")


def expected(text):
    out = []
    words = pieces.words_of(text or "")
    place = [int(x) % pieces.PRIME for x in mixed(np.arange(1, len(words) + 1, dtype=np.uint64))]
    for algorithm in ("viterbi", "merged"):
        ids = [word_ids(w, algorithm) for w in words]
        out.append((sum(map(len, ids)), ids, place))
    return len(words), out


@pytest.mark.parametrize("frequent", [1 << 19, 50])
def test_summary(spark, monkeypatch, frequent):
    monkeypatch.setattr(pieces, "FREQUENT_WORDS", frequent)
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL_DIR}/documents.parquet' ORDER BY doc_id").fetchall()][: 60 if frequent == 50 else 20] + ODD + ["same text"] * 3
    got = {r.doc_id: r for r in pieces.summarise(table(spark, docs)).collect()}
    assert len(got) == len(docs)
    codes = {}
    seen = {i for t in docs for _, out in [expected(t)] for _, ids, _ in out for i in ids}
    for r in spark.createDataFrame([(list(i),) for i in seen], "ids array<int>").select("ids", pieces.code_of(F.col("ids")).alias("code")).collect():
        codes[tuple(r.ids)] = r.code
    for k, text in enumerate(docs):
        n, (best, merged) = expected(text)
        r = got[k]
        assert (r.n_words, r.n_pieces, r.n_merged) == (n, best[0], merged[0])
        assert r.n_merged == len(MERGING.encode(text or ""))
        for have, (_, ids, place) in ((r.ids_checksum, best), (r.merged_checksum, merged)):
            assert have == sum(codes[i] * p % pieces.PRIME for i, p in zip(ids, place, strict=True)) % pieces.PRIME
        assert r.round_trip
    assert pieces.summarise(table(spark, [])).count() == 0


def test_query(spark):
    got = queries.QUERIES["op2_sentencepiece"](spark, SMALL_DIR).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL_DIR}/documents.parquet'").fetchall())
    assert {r.doc_id: r.n_merged for r in got} == {d: len(MERGING.encode(t or "")) for d, t in texts.items()}
    assert all(r.round_trip for r in got)


@pytest.mark.parametrize("frequent", [1 << 19, 1])
def test_whole_texts_decode(spark, monkeypatch, frequent):
    """The whole decoded text is compared: the sign for blanks does not come back."""
    monkeypatch.setattr(pieces, "FREQUENT_WORDS", frequent)
    got = {r.doc_id: (r.round_trip, r.text_round_trip) for r in pieces.summarise(table(spark, [*ODD, "x▁y"])).collect()}
    assert got == {k: (True, "▁" not in (t or "")) for k, t in enumerate([*ODD, "x▁y"])}
    assert all(pieces.plain("▁" + t.replace(" ", "▁")) == t for t in ODD if t and "▁" not in t)


def test_distinct_words():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB1é.,-( \n\t日”▁_×÷ɏɐȿĀ\r\x7f🙂", k=rng.randrange(30))) for _ in range(3000)]
    words, at, ends = pieces.distinct_words(pa.array(texts))
    assert len(set(words)) == len(words)
    assert [[words[k] for k in at[a:b]] for a, b in zip(ends[:-1], ends[1:])] == [pieces.words_of(t) for t in texts]


def test_numbers_packed():
    for values in ([], [0], [5, 0, 1 << 31, 70000]):
        assert pieces.unpacked_numbers(pieces.packed_numbers(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("frequent", [1 << 19, 50, 1])
def test_whole_documents(spark, monkeypatch, frequent):
    """The ids of whole documents are those of the library, word by word and whole, and one id that
    stands for other text is seen in the decoded text."""
    monkeypatch.setattr(pieces, "FREQUENT_WORDS", frequent)
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL_DIR}/documents.parquet' ORDER BY doc_id LIMIT 30").fetchall()] + ODD
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    wanted = {}
    for k, t in enumerate(docs):
        best = [i for w in pieces.words_of(t or "") for i in word_ids(w, "viterbi")]
        wanted[k] = (crc(best), crc(MERGING.encode(t or "")))
    assert {r.doc_id: (r.ids_crc32, r.merged_crc32) for r in pieces.summarise(table(spark, docs)).collect()} == wanted
    right = pieces.piece_bytes(VOCAB)
    word = VOCAB.ids["▁the"]
    monkeypatch.setattr(pieces, "piece_bytes", lambda vocab: [b"THE" if k == word else b for k, b in enumerate(right)])
    got = {r.doc_id: (r.round_trip, r.text_round_trip) for r in pieces.summarise(table(spark, ["in the house", "a house", None])).collect()}
    assert got == {0: (False, False), 1: (True, True), 2: (True, True)}


def test_rare_words_packed(spark):
    """What rare words take to a block comes back by their places, null merges like the Viterbi path."""
    rows = [(7, k, [k, 3], None if k % 2 else [k, 5, 9], 100 + k, None if k % 2 else 200 + k, k % 3) for k in range(40)] + [(8, 0, [], None, 1, None, 1)]
    df = spark.createDataFrame(rows[::-1], "home long, at int, viterbi array<smallint>, merged array<smallint>, code int, merged_code int, same int").repartition(3)
    found = pieces.packed_words(df).collect()
    assert len(found) <= 6
    got = pieces.unpacked_words([r.words for r in found if r.home == 7])
    wanted = pa.table({c: pa.array([r[k] for r in rows[:40]], t) for k, (c, t) in enumerate([("viterbi", pa.list_(pa.int16())), ("merged", pa.list_(pa.int16())), ("code", pa.int32()), ("merged_code", pa.int32()), ("same", pa.int32())], start=2)})
    for name, value in pieces.coded_words(wanted).items():
        for have, want in zip(got[name], value, strict=True) if isinstance(value, tuple) else [(got[name], value)]:
            assert have.tolist() == want.tolist(), name
    assert got["at"].tolist() == list(range(40))
    assert [x.tolist() for x in pieces.unpacked_words([])["merged"]] == [[], [0]]


def test_blocks_are_shuffled_once(spark, monkeypatch):
    """Both readers of the documents' blocks use one shuffle, and no table of them is written."""
    monkeypatch.setattr(pieces, "FREQUENT_WORDS", 1)
    df = pieces.summarise(table(spark, ["in the house", "xqzkjv house", None]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1


def test_lattice_has_every_piece(spark):
    """Substrings are exploded to the lengths that pieces with their first characters have, which leaves
    out no piece and many substrings."""
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choices(["the", "ing", "an", "é", "日", "st", "ou", "x", "."], k=rng.randrange(1, 14))) for _ in range(200)]
    words = [w for w in dict.fromkeys(words) if len(w) <= pieces.LONGEST_WORD] + ["a", "▁", "🙂"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").coalesce(1)
    got, word = {}, None
    for r in pieces.lattice(df, VOCAB).collect():
        word = r.word or word
        got.setdefault(word, []).append((r.edge >> 8 & 255, r.edge & 255, (r.edge >> 16) - 1))
    for w in words:
        spans = [(a, b - a, VOCAB.ids.get(w[a:b], -1)) for a in range(len(w)) for b in range(a + 1, len(w) + 1)]
        assert got[w] == [(a, n, i) for a, n, i in spans if i >= 0 or n == 1], w
    lengths = {r.head: r.lengths for r in pieces.length_table(spark, VOCAB).collect()}
    tried = sum(n <= len(w) - a for w in words for a in range(len(w)) for n in lengths.get(w[a : a + pieces.HEAD], range(1, pieces.HEAD)))
    assert tried < 0.6 * sum(min(VOCAB.longest, len(w) - a) for w in words for a in range(len(w)))


def test_words_are_decoded_where_they_are_folded(spark):
    """One Python worker of a task folds and decodes; a word whose ids stand for other text is seen."""
    df = spark.createDataFrame([("▁the", 1), ("▁日x", 2), ("z" * 70, 3)], "word string, n long").coalesce(1)
    checked = pieces.checked_words(df, VOCAB)
    assert checked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow") == 1
    assert {r.word: (r.n, r.same) for r in checked.collect()} == {"▁the": (1, 1), "▁日x": (2, 1), "z" * 70: (3, 1)}
    ids = pa.array([[VOCAB.ids["▁the"], VOCAB.first_byte], [], [VOCAB.first_byte + 255]], pa.list_(pa.int32()))
    assert pieces.decoded(ids, pa.array(pieces.piece_bytes(VOCAB), pa.large_binary())).to_pylist() == ["▁the".encode() + b"\0", b"", b"\xff"]


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pieces, "COUNTED_WORDS", 3)
    texts = ["a b c a", "", None, "b\nb d e", "a  b (c)"] * 3
    wanted = {}
    for w in (w for t in texts for w in pieces.words_of(t or "")):
        wanted[w] = wanted.get(w, 0) + 1
    docs = table(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert {r.word: r.n for r in pieces.word_counts(docs).collect()} == wanted


@pytest.mark.parametrize("held", [1, 5 << 20])
def test_words_of_several_slices_are_numbered_together(spark, monkeypatch, held):
    """Frequent words are looked up in one array for all slices of a task, not in a dict of each worker."""
    monkeypatch.setattr(pieces, "NUMBERED_BYTES", held)
    monkeypatch.setattr(pieces, "FREQUENT_WORDS", 4)
    texts = [f"the house {k} of x{k} " * 60000 for k in range(5)] + ["", "x3 the"]
    got = {r.doc_id: r for r in pieces.summarise(table(spark, texts).coalesce(1)).collect()}
    for k, text in enumerate(texts):
        ids = MERGING.encode(text)
        assert (got[k].n_merged, got[k].merged_crc32, got[k].text_round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
