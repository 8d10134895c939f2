"""Hard negatives against a plain search over all rows."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trainlake.llm import negatives, queries


def plain(rows, anchors, positives=5, low=30, high=90, most=10):
    """``rows`` are ``(vec_id, label, vector)``; anchors and results by their definition."""
    fine = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1 << 14 for c in v)]
    out = set()
    for anchor in sorted({i for i, _, _ in fine if anchors(i)}):
        _, label, own = min(r for r in fine if r[0] == anchor)
        score = lambda v: sum(a * b for a, b in zip(own, v, strict=False))  # noqa: E731, B023
        others = sorted({(-score(v), i, lab == label) for i, lab, v in fine if i != anchor})
        same = [(i, -s) for s, i, alike in others if alike][:positives]
        for positive, p in same:
            window = [(i, -s) for s, i, alike in others if not alike and low * p <= -100 * s <= high * p][:most]
            out |= {(anchor, positive, k + 1, i, p, s) for k, (i, s) in enumerate(window)}
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_query(spark, name):
    read = duckdb.sql(f"SELECT vec_id, label, embedding FROM '/root/testdata/{name}/embeddings.parquet'").fetchall()
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in read]
    have = got(queries.QUERIES["op13_hard_negatives"](spark, f"/root/testdata/{name}"))
    assert have == plain(rows, lambda i: i % 100 == 0) and have


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 0, b"", 1) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, cell int, vector binary, rank int")


def clusters(rng, n, dims, labels=4):
    centres = rng.standard_normal((labels * 2, dims))
    return [(k, int(k % labels), [float(c) for c in centres[k % len(centres)] + 0.3 * rng.standard_normal(dims)]) for k in range(n)]


def test_many_cells_and_rounds(spark, monkeypatch):
    """Small cells, blocks and chunks and a first round of a few rows: cells are skipped, results whole."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rows = clusters(np.random.default_rng(1), 600, 6)
    df = negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, cell_rows=9)
    assert got(df) == plain(rows, lambda i: i % 20 == 0)


def test_search_stops_early(spark):
    """Clustered vectors: the certified search leaves most cells unvisited."""
    rows = clusters(np.random.default_rng(2), 800, 4)
    df = negatives.usable(frame(spark, rows), "vec_id", "embedding", F.col("label"))
    index = negatives.build_index(df, cell_rows=8)
    query = np.array([math.floor(256 * c) for c in rows[0][2]])
    cells, pops, bound = negatives.visited(negatives.half_bounds(query, index.words, index.radii), index.counts, 0, 50)
    scores = {i: sum(math.floor(256 * a) * int(b) for a, b in zip(v, query, strict=True)) for i, _, v in rows}
    held = set()
    for r in index.blocks.filter(F.col("cell").isin(cells)).collect():
        held |= set(np.frombuffer(r.ids, np.int64).tolist())
    assert 50 <= len(held) < 400 and max(s for i, s in scores.items() if i not in held) <= bound
    every, pops, last = negatives.visited(negatives.half_bounds(query, index.words, index.radii), index.counts, 0, 10**9)
    assert pops == len(index.counts) and last == -math.inf and len(every) == (index.counts > 0).sum()


def test_one_hot_vector(spark):
    """A third of all rows are one vector: its cell is many blocks, ties go by id."""
    rows = clusters(np.random.default_rng(3), 200, 5) + [(1000 + k, k % 2, [0.5, 0.25, -1.0, 2.0, 0.0]) for k in range(100)]
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, cell_rows=10)) == plain(rows, lambda i: i % 50 == 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = clusters(rng, 60, 3) * 2
    rows += [(3, 0, [1.0, 2.0, 3.0]), (3, 1, [1.0, 2.0, 3.0]), (7, 2, [0.0, 0.0, 0.0]), (8, 1, []), (9, 2, [5.0]), (70, 0, [900.0, -900.0, 1.5])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (90, None, [1.0, 1.0, 1.0]), (91, 1, None), (92, 1, [None, 1.0, 1.0]), (93, 1, [math.nan, 1.0, 1.0]), (94, 1, [math.inf, 1.0, 1.0]), (95, 1, [1e30, 1.0, 1.0])]
    assert got(negatives.mine(frame(spark, rows))) == plain(rows, lambda i: True)


def test_few_rows(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.5]), (3, 1, [0.5, 0.5]), (4, 2, [-1.0, 0.0])]
    assert got(negatives.mine(frame(spark, rows))) == plain(rows, lambda i: True)
    assert negatives.mine(frame(spark, rows).limit(0)).collect() == []
    assert negatives.mine(frame(spark, rows[:1])).collect() == []
    assert negatives.mine(frame(spark, rows), F.lit(False)).collect() == []
    assert negatives.mine(frame(spark, [(1, 0, []), (2, 0, []), (3, 1, [])])).count() == 2


def asked_all(spark, rows, n_queries, **options):
    """An index of ``rows``, and its first ``n_queries`` rows as open queries with one open window."""
    df = negatives.usable(frame(spark, rows), "vec_id", "embedding", F.col("label"))
    index = negatives.build_index(df, **options)
    one = F.array(F.lit(negatives.LOWEST + 1).cast("long")), F.array(F.lit(negatives.HIGHEST).cast("long"))
    queries = df.filter(F.col("vec_id") < n_queries).select(F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "label", one[0].alias("lows"), one[1].alias("highs"), "vector")
    return index, queries


def test_requests_are_not_broadcast(spark):
    """The files of requests are far smaller than their rows: the driver must not gather them by that size."""
    index, queries = asked_all(spark, clusters(np.random.default_rng(5), 900, 4), 200, cell_rows=9)
    state = queries.withColumn("worst", F.transform("lows", lambda _: F.lit(negatives.LOWEST).cast("long"))).withColumn("pops", F.lit(0).cast("long"))
    asked = negatives.written(negatives.requests(state, index, 900, negatives.RUN), "asked")
    assert int(asked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20
    pairs = negatives.scored(asked, index, True, 5, negatives.RUN)
    assert pairs.count() and "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_in_whole_job(spark, monkeypatch):
    """No join of the job depends on what its tables take as files."""
    plans = []

    def logged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = negatives.written
    monkeypatch.setattr(negatives, "written", logged)
    out = negatives.mine(frame(spark, clusters(np.random.default_rng(6), 300, 4)), F.col("vec_id") % 20 == 0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() and any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_requests_by_runs(spark):
    """A query that asks for all cells goes to each run once, and asks for each cell once."""
    index, queries = asked_all(spark, clusters(np.random.default_rng(7), 900, 4), 10, cell_rows=4)
    cells = int((index.counts > 0).sum())
    assert cells > 2 * negatives.RUN and negatives.run_width(index.counts, 900) == negatives.RUN and negatives.run_width(index.counts, 10) == 1
    state = queries.withColumn("worst", F.col("lows")).withColumn("pops", F.lit(0).cast("long"))
    for width in (1, negatives.RUN):
        asked = [r for r in negatives.requests(state, index, 900, width).collect() if r.run is not None]
        per_query = -(-len(index.counts) // width)
        assert len(asked) <= 10 * per_query and sum(bin(r.wants).count("1") for r in asked) == 10 * cells
        own = {r.run * width + k for r in asked if r["query"] == 3 for k in range(width) if r.wants >> k & 1}
        assert own == set(np.nonzero(index.counts)[0].tolist())


@pytest.mark.parametrize("run", [1, 4, 63])
def test_rounds_by_cells_and_runs(spark, monkeypatch, run):
    """Rounds of few cells, then of runs of cells, with small blocks and chunks: whole results."""
    monkeypatch.setattr(negatives, "RUN", run)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rows = clusters(np.random.default_rng(8), 500, 6)
    index, queries = asked_all(spark, rows, 12, cell_rows=5)
    found = negatives.search(queries, index, True, 5, first_rows=10)
    whole = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows]
    expected = set()
    for i, lab, v in whole[:12]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, other, w in whole if other == lab and j != i)[:5]
        expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {(r["query"], r["rank"], r.vec_id, r.score) for r in found.collect()} == expected
