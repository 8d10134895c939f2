"""The pipeline's stages, each against plain code on what the stage before it kept."""

from __future__ import annotations

import corpus_pipeline
import pytest
from test_ngram_join import expected

from trainlake.llm import language
from trainlake.llm.common import prepared, table, written

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Documents before the first stage and after each one."""
    prepared(spark)
    own = spark.createDataFrame(
        [(10_001, None, None, "own", None), (10_002, "12 34 -- 56", None, "own", 11), (10_003, "", "en", "own", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    out = [written(table(spark, SMALL_DIR, "documents").unionByName(own), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL_DIR), name.replace(" ", "-")))
    return [{r.doc_id: r for r in df.collect()} if k < 4 else df.collect() for k, df in enumerate(out)]


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "packing"]


def test_rows_stay_as_they_are(kept):
    for rows in kept[1:4]:
        assert rows and all(kept[0][k] == r for k, r in rows.items())


def test_language(kept):
    gone = set(kept[0]) - set(kept[1])
    assert {10_001, 10_002, 10_003} <= gone
    assert all(not any(c.isalpha() for c in kept[0][d].text or "") for d in gone)


def test_exact_dedup(kept):
    last = {}
    for d, r in sorted(kept[1].items()):
        last[r.text] = d
    assert set(kept[2]) == set(last.values()) and len(kept[2]) < len(kept[1])


def test_near_dedup(kept):
    groups = expected([(d, r.text) for d, r in kept[2].items()])
    assert set(kept[3]) == {d for d, (_, c) in groups.items() if c == d} and len(kept[3]) < len(kept[2])


def test_packing(kept):
    assert {p.doc_id for p in kept[4]} == set(kept[3])


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, SMALL_DIR).collect()
    assert {p.doc_id for p in got} == set(kept[3])
    assert language.UNKNOWN == "und"


def test_rows_without_an_id(spark):
    """Equal and near-equal texts without an id: one row stays, or the one that has an id."""
    prepared(spark)
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:-1], end]) for end in ("x", "y", "z")]
    docs = [(None, near[0])] * 20 + [(None, near[1]), (7, "alone in the world of texts"), (None, "no id and no like of it at all"), (None, "")]
    for own, expected in (([], {None}), ([(5, near[2])], {5})):
        df = spark.createDataFrame(docs + own, "doc_id long, text string").repartition(4)
        once = written(corpus_pipeline.exact_dedup_stage(spark, df, SMALL_DIR), "once")
        assert once.count() == 5 + len(own)
        got = corpus_pipeline.near_dedup_stage(spark, once, SMALL_DIR)
        assert got.columns == df.columns
        rows = [(r.doc_id, r.text) for r in got.collect()]
        assert len(rows) == 4 and {d for d, t in rows if t in near} == expected


def test_rows_that_share_an_id(spark):
    """An unrelated text stays though another row of its id is a near copy."""
    prepared(spark)
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:-1], end]) for end in ("x", "y")]
    docs = [(3, near[0]), (5, near[1]), (5, "an unrelated text that has its own words alone"), (5, "an unrelated text that has its own words alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, df, SMALL_DIR).collect()}
    assert got == {docs[0], docs[2]}


CLASHING = "doc_id long, text string, lang string, _id long, _kept_key string, _kept_place int, _lang string, _score double, lang_pred string, Score double, number int, key string, place int, row int, component_id int, `a.b` int"


def clashing(spark):
    texts = [f"the cat and the dog number {k} went over the hills to the sea" for k in range(30)] + [f"der hund und die katze nummer {k} liefen ueber die berge zum meer" for k in range(30)]
    texts += [texts[0], texts[31], None, "", "12 34"]
    own = [(k, t, ("en" if k < 30 else "de") if k < 60 else None, -k, f"k{k}", 7, "l", 0.5, "p", 0.25, 9, "y", 8, 3, 4, k) for k, t in enumerate(texts)]
    return spark.createDataFrame(own, CLASHING)


def test_columns_stay_as_they_are(spark):
    prepared(spark)
    docs = clashing(spark)
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL_DIR), "clashing")
        assert docs.columns == [f.name for f in clashing(spark).schema.fields], name
        rows = docs.collect()
        assert rows and all(r == given[r.doc_id] for r in rows), name
    assert {p.doc_id for p in corpus_pipeline.packing_stage(spark, docs, SMALL_DIR).collect()} == {r.doc_id for r in rows}


def test_empty_table(spark):
    prepared(spark)
    docs = clashing(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL_DIR)
        assert out.collect() == [], name


def test_very_long_texts(spark):
    """A text of a million words, a near copy of it and one word of three million letters."""
    prepared(spark)
    words = [f"word{k * 7919 % 100003}" for k in range(1_000_000)]
    docs = [(1, " ".join(words), "en"), (2, " ".join([*words[:-5], "other"]), "en"), (3, "a" * 3_000_000, "en"), (4, "short one", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, SMALL_DIR), "long")
    assert sorted(r.doc_id for r in df.collect()) == [1, 3, 4]
    pieces = corpus_pipeline.packing_stage(spark, df, SMALL_DIR)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {1, 3, 4}
