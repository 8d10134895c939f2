"""Hard negatives by exact search in an inverted multi-index.

1. *Codebooks.* Vectors are cut in two halves; k-means on a bounded sample gives a codebook per half.
   All rows are indexed: a row's cell is the pair of its nearest codewords. A codeword's
   radius is the largest distance of any row's half from it, over all rows.
2. *Blocks.* The rows of a cell lie in blocks of up to ``BLOCK_ROWS``, so a cell that holds a third of
   all rows is many rows of the table. The index is written once.
3. *Search.* For a query the halves of a cell give a bound: the inner product with the codeword,
   plus the length of the query's half times the radius. The multi-sequence heap pops cells by falling
   sum of both bounds, so no row of an unvisited cell scores above the next cell's bound.
   Queries visit cells in rounds, few at first and then ever more; queries that ask for one cell
   go to it together. In a round of many cells a query goes once to each run of ``RUN`` cells, with
   the cells that it asks for as bits, so that its vector is not copied for every cell.
4. *Windows.* A query wants the best rows in score windows. A window is certified, and done, once its
   last row beats the next bound, or the next bound falls below the window. A query
   whose windows are all certified stops.

The first search has one open window over rows of the same label (the positives), the second has
a window for each positive over rows of other labels. Both are exact: cells that are not visited
cannot matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value, written

ship_by_value(__name__)

SCALE = 256
#: Whole numbers from this on take no part: a hundred times a score has to fit in a long.
LARGEST = 1 << 22
#: The codebooks are fitted on at most about so many rows, chosen by the hash of their id.
SAMPLE = 1 << 14
#: A cell should hold about so many rows; a codebook has at most so many codewords.
CELL_ROWS, CODEWORDS = 256, 64
BLOCK_ROWS, CHUNK = 2048, 512
#: Cells of a run, at most 63 (the bits of a long). Runs are used from a round on where a query asks
#: for so many cells, and for so great a share of all, that a block still meets many queries that want it.
RUN, RUN_SHARE = 32, 1 / 16
#: Rows that a query's cells of the first round hold, and growth of that by round.
FIRST_ROWS, GROWTH = 2048, 8
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def joined(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of shuffled sides. Spark takes the size of a written table from its compressed files, and
    the files of requests are a hundredth of their rows: it would gather them on the driver to broadcast them."""
    return left.hint("merge").join(right, on, how)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``vec_id, label, vector`` with whole numbers ``floor(256 x)``, of rows that take part."""
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), col(vector_col).cast("array<double>").alias("given"))
    whole = rows.withColumn("vector", F.transform("given", lambda c: F.floor(SCALE * c)))
    fine = F.forall("given", lambda c: F.coalesce(F.abs(c) < LARGEST / SCALE, F.lit(False)) & ~F.isnan(c))
    return whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select("vec_id", "label", "vector")


def dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector ends in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def codebook(points: np.ndarray, size: int, turns: int = 12) -> np.ndarray:
    """Codewords of k-means, started far apart from each other."""
    points = np.unique(points, axis=0).astype(np.float64)
    rng = np.random.default_rng(len(points))
    words = points[rng.integers(len(points))][None]
    away = ((points - words[0]) ** 2).sum(axis=1)
    while len(words) < size and away.max() > 0:
        words = np.vstack([words, points[rng.choice(len(points), p=away / away.sum())]])
        away = np.minimum(away, ((points - words[-1]) ** 2).sum(axis=1))
    for _ in range(turns):
        at = nearest(points, words)
        words = np.stack([points[at == k].mean(axis=0) if (at == k).any() else words[k] for k in range(len(words))])
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * (points @ words.T)).argmin(axis=1)


@dataclass(frozen=True)
class Index:
    """Number of dimensions and type of the stored numbers, codebooks, their radii, the rows by cell
    (at most ``CODEWORDS`` squared), and the blocks."""

    dims: int
    kind: type
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    blocks: DataFrame


BLOCK = "cell int, ids binary, labels binary, vectors binary"


def build_index(rows: DataFrame, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> Index | None:
    """The index of all rows; None for an empty table."""
    largest = F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda most, c: F.greatest(most, F.abs(c))))
    total, dims, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), largest).first()
    if not total:
        return None
    dims, kind = max(2, dims), np.int16 if most < 1 << 15 else np.int32
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(min(1.0, sample / total) * (1 << 30))
    drawn = rows.filter(chosen).limit(2 * sample).select(F.col("vector").cast("array<int>")).toArrow().column(0)
    drawn = dense(drawn.combine_chunks() if len(drawn) else pa.array([[]], pa.list_(pa.int32())), dims)
    size = max(1, min(CODEWORDS, math.isqrt(total // cell_rows)))
    half = dims // 2
    words = (codebook(drawn[:, :half], size), codebook(drawn[:, half:], size))
    second = len(words[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("vector"), dims)
            at = [nearest(part.astype(np.float64), w) for part, w in zip((x[:, :half], x[:, half:]), words, strict=True)]
            away = [np.sqrt(((part - w[k]) ** 2).sum(axis=1)) for part, w, k in zip((x[:, :half], x[:, half:]), words, at, strict=True)]
            cells = pa.array((at[0] * second + at[1]).astype(np.int32))
            whole = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([cells, batch.column("vec_id"), batch.column("label"), pa.array(away[0]), pa.array(away[1]), whole], names=["cell", "vec_id", "label", "away_0", "away_1", "x"])

    placed = rows.mapInArrow(place, "cell int, vec_id long, label long, away_0 double, away_1 double, x binary")
    # The hint lets a cell of many rows be split over several tasks.
    dealt = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id", "label", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.nonzero(np.diff(cells))[0] + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                for at in range(lo, hi, BLOCK_ROWS):
                    part = batch.slice(at, min(BLOCK_ROWS, hi - at))
                    if part.num_rows:
                        yield packed_block(part)

    def packed_block(part: pa.RecordBatch) -> pa.RecordBatch:
        away = [float(part.column(f"away_{k}").to_numpy().max()) for k in (0, 1)]
        binary = [pa.array([part.column(c).to_numpy().tobytes()], pa.binary()) for c in ("vec_id", "label")]
        whole = pa.array([b"".join(part.column("x").to_pylist())], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("cell").slice(0, 1), *binary, whole, pa.array([part.num_rows], pa.int64()), *(pa.array([a]) for a in away)], names=["cell", "ids", "labels", "vectors", "n", "away_0", "away_1"])

    blocks = written(dealt.mapInArrow(pack, BLOCK + ", n long, away_0 double, away_1 double"), "multi-index")
    summary = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("away_0").alias("away_0"), F.max("away_1").alias("away_1")).collect()
    counts, radii = np.zeros(len(words[0]) * second, np.int64), (np.zeros(len(words[0])), np.zeros(second))
    for r in summary:
        counts[r.cell] = r.n
        for side, k in enumerate(divmod(r.cell, second)):
            radii[side][k] = max(radii[side][k], r[f"away_{side}"])
    return Index(dims, kind, words, radii, counts, blocks)


def half_bounds(query: np.ndarray, words: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each half and codeword the largest inner product that a row's half can have with the
    query's, rounding included."""
    half = words[0].shape[1]
    out = []
    for part, w, r in zip((query[:half].astype(np.float64), query[half:].astype(np.float64)), words, radii, strict=True):
        bound = w @ part + np.linalg.norm(part) * r
        out.append(bound + 1e-9 * (np.abs(w) @ np.abs(part) + np.linalg.norm(part) * r) + 1e-3)
    return out


def visited(bounds: list[np.ndarray], counts: np.ndarray, skip: int, rows: int) -> tuple[list[int], int, float]:
    """The multi-sequence algorithm: cells by falling sum of the half bounds, from the ``skip``-th
    pop on, until they hold ``rows`` rows. Returns them, the pops in all, and the next bound."""
    orders = [np.argsort(-b, kind="stable") for b in bounds]
    first, second = (b[o].tolist() for b, o in zip(bounds, orders, strict=True))
    heap, seen = [(-(first[0] + second[0]), 0, 0)], {(0, 0)}
    cells, pops, held = [], 0, 0
    while heap and held < rows:
        _, i, j = heapq.heappop(heap)
        pops += 1
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < len(second) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(first[a] + second[b]), a, b))
        cell = int(orders[0][i]) * len(second) + int(orders[1][j])
        if pops > skip and counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
    return cells, pops, -heap[0][0] if heap else -math.inf


REQUEST = "query long, own long, label long, lows array<long>, highs array<long>, worst array<long>, vector array<long>, x binary, run int, wants long, pops long, bound long"
FOUND = "query long, window int, score long, vec_id long"


def run_width(counts: np.ndarray, rows: int) -> int:
    """Cells of a run in a round of ``rows`` rows a query: 1 where a query asks for few cells."""
    held = counts[counts > 0]
    asked = min(len(held), rows / np.median(held))
    return RUN if asked >= max(RUN, RUN_SHARE * len(held)) else 1


def by_run(cells: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the cells, which are distinct, and for each run its cells as bits."""
    runs, at = np.unique(np.array(cells, np.int64) // width, return_inverse=True)
    wants = np.zeros(len(runs), np.int64)
    np.bitwise_or.at(wants, at, np.int64(1) << np.array(cells, np.int64) % width)
    return runs, wants


def requests(state: DataFrame, index: Index, rows: int, width: int) -> DataFrame:
    """Requests of the open queries for their next cells, one for each ``run`` of ``width`` cells, with
    the next bound of each query in the row without a run."""
    words, radii, counts, dims, kind = index.words, index.radii, index.counts, index.dims, index.kind

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = dense(batch.column("vector"), dims)
            for k in range(batch.num_rows):
                cells, pops, bound = visited(half_bounds(vectors[k], words, radii), counts, batch.column("pops")[k].as_py(), rows)
                runs, wants = by_run(cells, width)
                n = len(runs) + 1
                one = batch.slice(k, 1)
                asked = one.select(["query", "own", "label", "lows", "highs", "worst"]).take(pa.array([0] * n))
                # Only the row without a run needs the vector as it is.
                own = [pa.array([None] * (n - 1) + one.column("vector").to_pylist(), pa.list_(pa.int64())), pa.array([vectors[k].astype(kind).tobytes()] * n, pa.binary())]
                # Rounded up: a row may score as much as the bound.
                next_bound = LOWEST if bound == -math.inf else math.floor(min(bound, HIGHEST - 1))
                more = [*own, pa.array([*runs.tolist(), None], pa.int32()), pa.array([*wants.tolist(), None], pa.int64()), pa.array([pops] * n, pa.int64()), pa.array([next_bound] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*asked.columns, *more], names=[*asked.schema.names, "vector", "x", "run", "wants", "pops", "bound"])

    return state.mapInArrow(task, REQUEST)


def chunks(asked: DataFrame) -> DataFrame:
    """Up to ``CHUNK`` queries for one run of cells in one row."""
    dealt = asked.filter("run IS NOT NULL").drop("vector", "pops", "bound").hint("rebalance", "run").sortWithinPartitions("run", "query")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_numpy()
            edges = np.nonzero(np.diff(runs))[0] + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(runs)], strict=True):
                for at in range(lo, hi, CHUNK):
                    part = batch.slice(at, min(CHUNK, hi - at)).select(["query", "own", "label", "lows", "highs", "worst", "x", "wants"])
                    if part.num_rows:
                        stream = pa.BufferOutputStream()
                        with pa.ipc.new_stream(stream, part.schema) as out:
                            out.write_batch(part)
                        yield pa.RecordBatch.from_arrays([pa.array([int(runs[lo])], pa.int32()), pa.array([stream.getvalue().to_pybytes()], pa.binary())], names=["run", "asked"])

    return dealt.mapInArrow(task, "run int, asked binary")


def best_rows(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the up to ``k`` best fitting scores of each row; of equal scores those with
    the smaller id, and of equal scores of one id one. Columns are in ascending order of id."""
    n = scores.shape[1]
    enough = k + int((ids[1:] == ids[:-1]).sum())
    if n > enough:
        least = np.partition(np.where(fits, scores, LOWEST), n - enough, axis=1)[:, n - enough]
        fits = fits & (scores >= least[:, None])
    rows, columns = np.nonzero(fits)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    found = scores[rows, columns]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:] == rows[:-1]) & (ids[columns[1:]] == ids[columns[:-1]]) & (found[1:] == found[:-1])
    rows, columns = rows[~again], columns[~again]
    first = np.searchsorted(rows, rows)
    chosen = np.arange(len(rows)) - first < k
    return rows[chosen], columns[chosen]


def table_of(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def scored(asked: DataFrame, index: Index, same: bool, k: int, width: int) -> DataFrame:
    """``query, window, score, vec_id``: the best rows of each block for the windows of the queries
    that asked for its cell; rows that a window has no more room for are left out."""
    dims, kind = index.dims, index.kind
    blocks = index.blocks.select(F.floor(F.col("cell") / width).cast("int").alias("run"), (F.col("cell") % width).alias("place"), "ids", "labels", "vectors")
    pairs = joined(chunks(asked), blocks, "run")

    def block_rows(block: dict) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(block["asked"]) as stream:
            queries = stream.read_next_batch()
        queries = queries.filter(pa.array(queries.column("wants").to_numpy() >> block["place"] & 1 == 1))
        if not queries.num_rows:
            return
        ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
        vectors = np.frombuffer(block["vectors"], kind).reshape(len(ids), dims)
        names, own, label = (queries.column(c).to_numpy() for c in ("query", "own", "label"))
        asking = np.frombuffer(b"".join(queries.column("x").to_pylist()), kind).reshape(len(names), dims)
        scores = products(asking, vectors)
        wanted = ((labels == label[:, None]) == same) & (ids != own[:, None])
        lows, highs, worst = (table_of(queries.column(c)) for c in ("lows", "highs", "worst"))
        least = np.maximum(lows, worst)
        for w in range(lows.shape[1]):
            fits = wanted & (scores >= least[:, w, None]) & (scores <= highs[:, w, None])
            at, column = best_rows(scores, fits, ids, k)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(np.full(len(at), w, np.int32)), pa.array(scores[at, column]), pa.array(ids[column])], names=["query", "window", "score", "vec_id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from block_rows(batch.slice(row, 1).to_pylist()[0])

    return pairs.select("asked", "place", "ids", "labels", "vectors").mapInArrow(task, FOUND)


def search(queries: DataFrame, index: Index, same: bool, k: int, first_rows: int = FIRST_ROWS) -> DataFrame:
    """``query, window, score, vec_id, rank``: for each query and window, exactly the ``k`` best rows
    (all, if fewer) with a score between ``lows[window]`` and ``highs[window]`` and the query's label
    (``same``) or another one, but for rows of the query's own id.

    ``queries`` has ``query, own, label, lows, highs, vector``; every query has the same number of
    windows. ``query`` is a key.
    """
    spark = queries.sparkSession
    open_worst = F.transform("lows", lambda _: F.lit(LOWEST).cast("long"))
    state = written(queries.withColumn("worst", open_worst).withColumn("pops", F.lit(0).cast("long")), "queries")
    found = spark.createDataFrame([], FOUND)
    done: list[DataFrame] = []
    order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "vec_id")
    rows = first_rows
    while not state.isEmpty():
        width = run_width(index.counts, rows)
        asked = written(requests(state, index, rows, width), "cell-requests")
        candidates = found.unionByName(scored(asked, index, same, k, width)).distinct()
        best = written(candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best-rows")
        # A window's k-th score, where it has one.
        full = best.filter(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
        now = joined(asked.filter("run IS NULL"), full, "query", "left")
        certain = F.expr("""
            forall(sequence(0, size(lows) - 1), w -> bound < lows[w] OR lows[w] > highs[w] OR coalesce(bound < last[w], false))
        """)
        worst = F.expr(f"transform(sequence(0, size(lows) - 1), w -> coalesce(last[w], {LOWEST}L))")
        marked = written(now.withColumn("done", certain | (F.col("bound") == LOWEST)).withColumn("worst", worst).drop("last", "run", "wants", "bound", "x"), "query-state")
        finished = marked.filter("done").select("query")
        done.append(joined(best, finished, "query", "left_semi"))
        state = marked.filter("NOT done").drop("done")
        found = joined(best, finished, "query", "left_anti").select("query", "window", "score", "vec_id")
        rows *= GROWTH
    out = done[0] if done else found.withColumn("rank", F.lit(0))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame,
    anchors: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    **options,
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows without id, label or vector, or with an entry that is null, not finite or of 2**14 or more,
    take no part. An entry x becomes ``floor(256 x)``, a shorter vector ends in zeros, and a score is
    the whole inner product with the anchor. ``anchors`` is a condition on ``vec_id`` (by default
    all rows). An anchor's positives are its ``positives`` best other rows of its label; for each
    the ``negatives`` best rows of other labels follow whose score is ``low`` to ``high`` percent
    of the positive's. Ties go to the smaller id. Rows that repeat an id count once where they
    score alike; an anchor id on several rows is searched by the first of them in order of label and
    vector, and its rows are never its own positives or negatives. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, col("label") if label is None else label)
    index = build_index(rows, **options)
    if index is None:
        return spark.createDataFrame([], RESULT)
    chosen = (rows if anchors is None else rows.filter(anchors)).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    asked = written(chosen.select(F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "row.label", "row.vector"), "anchors")

    def window(low: Column, high: Column) -> DataFrame:
        return asked.withColumn("lows", F.array(low.cast("long"))).withColumn("highs", F.array(high.cast("long")))

    near = written(search(window(F.lit(LOWEST + 1), F.lit(HIGHEST)), index, True, positives), "positives")
    near = near.select(F.col("query").alias("anchor_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Windows of whole scores: 30 p <= 100 s <= 90 p.
    ends = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    first = F.expr(f"transform(sequence(1, {positives}), k -> if(k <= size(p), {_whole('ceil', low)}, 1L))")
    last = F.expr(f"transform(sequence(1, {positives}), k -> if(k <= size(p), {_whole('floor', high)}, 0L))")
    windows = joined(asked, ends.withColumn("lows", first).withColumn("highs", last), F.col("query") == F.col("anchor_id")).select("query", "own", "label", "lows", "highs", "vector")
    far = search(windows, index, False, negatives)
    far = far.select(F.col("query").alias("anchor_id"), (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = joined(near, far, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _whole(kind: str, percent: int) -> str:
    """SQL for ``percent`` hundredths of the k-th positive's score, rounded down or up, in longs."""
    product = f"({percent} * element_at(p, k).positive_score)"
    below = f"(({product} - pmod({product}, 100)) div 100)"
    return below if kind == "floor" else f"({below} + if(pmod({product}, 100) > 0, 1L, 0L))"
