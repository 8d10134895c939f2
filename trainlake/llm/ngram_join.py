"""Jaccard self-join of documents on word shingles, by signature trees.

Links are found exactly, in steps whose output is bounded by the rows, not by pairs:

1. ``shingle_rows``: size and key of each document's shingle set, and the shingles that are
   frequent in some part of the rows. Equal sets are one class from here on.
2. Shingles are ordered, frequent ones last and the most frequent ones at the end. Two sets that reach the similarity share one of
   the first ``n - ceil(t * n) + 1`` shingles of each, so the sets that have a shingle in that
   prefix form a *list* per shingle, which is the root of the signature tree over its sets.
3. A list of up to 16 sets is a tree of one leaf. The pairs of all leaves are counted: a pair
   that shares leaves only, and fewer of them than the similarity needs, is dropped.
4. In longer lists each set is paired with one or two others at first: the most central sets of
   its lists, those that are in most lists. Of what steps 3 and 4 found, the pairs whose token
   bitmaps allow the overlap are compared exactly; links collapse copies and near copies into
   components.
5. Longer lists that still hold several components are arranged as signature trees: sets
   ordered by size, 16 to a node and 16 nodes to the next, each node with the OR of its sets'
   token bitmaps, its size range and its component range. Pairs of nodes are traversed together
   from the roots; a pair is dropped when its sizes are too far apart, when it lies in one
   component, or when the bits that both have cannot make up the overlap that the similarity
   needs. A list is a forest of trees of up to 1024 sets of like size; each pair of trees is
   traversed on its own.
6. The pairs of sets that survive are compared exactly, and the components completed.

Nothing is lost: a pair of leaves or nodes is dropped only if it cannot reach the similarity or
is connected already, and step 4 only saves work of step 5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import cut_batches, id_and_text, ship_by_value, shuffle_partitions, slices, written
from trainlake.llm.components import connected_components
from trainlake.llm.shingles import Powers, shingle_sets

ship_by_value(__name__)

PERCENT = 75
#: A shingle is frequent in a window of rows if this many of the window's different sets have it.
#: Of those, the most frequent ones in all windows together, at most so many, go to all tasks. It
#: only changes the order, never the result.
WINDOW_SHINGLES = 1 << 21
FREQUENT_HERE, FREQUENT_SHINGLES = 2, 1 << 20
SLICE_BYTES = 1 << 20
LEAF, TREE = 16, 1024
FILTER_BITS = 1 << 24


def sets_of(batches: Iterator[pa.RecordBatch]):
    """``(doc ids, sets)`` for each slice of the rows."""
    powers = Powers()
    for part in slices(batches, "text", SLICE_BYTES):
        yield part.column("doc_id"), shingle_sets(part.column("text"), powers)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def shingle_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, n, key`` for documents and of ``token, times`` for frequent shingles."""

    names = ["doc_id", "n", "key", "token", "times"]

    def frequent(window: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(list(window.values())), return_counts=True)
        often = times >= FREQUENT_HERE
        window.clear()
        none = pa.nulls(int(often.sum()), pa.int64())
        found = [pa.array(signed(tokens[often]), pa.int64()), pa.array(times[often], pa.int64())]
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(none), pa.binary()), *found], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[bytes, np.ndarray] = {}
        held = 0
        for ids, sets in sets_of(batches):
            n = len(sets)
            keys = [set_key(s) if len(s) else None for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), sizes, pa.array(keys, pa.binary()), none, none], names=names)
            for key, own in zip(keys, sets, strict=True):
                if key is not None and key not in window:
                    window[key] = own
                    held += len(own)
            if held >= WINDOW_SHINGLES:
                yield frequent(window)
                held = 0
        if window:
            yield frequent(window)

    return docs.mapInArrow(task, "doc_id long, n long, key binary, token long, times long")


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts, sorted, and the step of the count of each; at most ``FREQUENT_SHINGLES``, cut where the
    count passes a step of an eighth power of two, so that no order of equal counts is needed."""
    counted = rows.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    counted = written(counted.withColumn("step", F.floor(8 * F.log2("times")).cast("int")), "frequent")
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)
    least, total = 1 << 20, 0
    for step, n in steps:
        total += n
        if total > FREQUENT_SHINGLES:
            break
        least = step
    found = counted.filter(F.col("step") >= least).select("token", F.col("step").cast("smallint").alias("step")).toArrow()
    tokens = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("step").to_numpy()[order]


def prefix(own: np.ndarray, take: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``take`` shingles of a sorted set in the common order: the others by value, then the
    frequent ones by their step and value."""
    tokens, steps = frequent
    if not len(tokens):
        return own[:take]
    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
    hot = tokens[at] == own
    rare = own[~hot]
    if len(rare) >= take:
        return rare[:take]
    order = np.argsort(steps[at[hot]], kind="stable")
    return np.concatenate([rare, own[hot][order[: take - len(rare)]]])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """``token, n, key, doc_id`` for the prefix of each set; of equal sets in one slice of the
    rows, the one with the smallest id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in sets_of(batches):
            seen: dict[bytes, tuple[int, int]] = {}
            for k, doc in enumerate(ids.to_pylist()):
                if doc is not None and len(sets[k]):
                    key = set_key(sets[k])
                    if key not in seen or doc < seen[key][0]:
                        seen[key] = (doc, k)
            tokens, sizes, keys, owners = [], [], [], []
            for key, (doc, k) in seen.items():
                own = sets[k]
                tokens.append(prefix(own, prefix_length(len(own), percent), frequent))
                sizes.append(len(own))
                keys.append(int.from_bytes(key[:8], "little", signed=True))
                owners.append(doc)
            if not tokens:
                continue
            counts = [len(t) for t in tokens]
            whole = signed(np.concatenate(tokens))
            columns = [np.repeat(np.array(v, np.int64), counts) for v in (sizes, keys, owners)]
            for lo in range(0, len(whole), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in (whole, *columns)], names=["token", "n", "key", "doc_id"])

    return docs.mapInArrow(task, "token long, n long, key long, doc_id long")


def size_class(percent: int) -> Column:
    """Sets of one class are close enough in size to be linked, and those of classes further
    than one apart are not, but for rounding; only used to arrange sets."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)))


def shared_lists(entries: DataFrame, percent: int) -> DataFrame:
    """``token, n, doc_id, size`` of the tokens that two or more different sets have in their
    prefix, and the number of entries. Of equal sets the smallest id stands for all."""
    whole = Window.partitionBy("token")
    along = whole.orderBy("n", "key", "doc_id")
    dealt = entries.repartition(shuffle_partitions(entries.sparkSession), "token")
    marked = dealt.select(
        "token",
        "n",
        "doc_id",
        F.lag("key").over(along).eqNullSafe(F.col("key")).alias("again"),
        F.count(F.lit(1)).over(whole).alias("size"),
        (F.min("key").over(whole) != F.max("key").over(whole)).alias("several"),
    )
    return marked.filter("several AND NOT again").select("token", "n", "doc_id", "size")


def central_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of each set with the most central set that it meets most often: the one of a
    whole list, and the one of its size class in a list. An edited copy meets its original in
    all lists but those of the edited shingles, and the original is in most lists."""
    lists = lists.select("token", "n", "doc_id")
    weighed = lists.join(lists.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lists")), "doc_id").withColumn("kind", size_class(percent))
    out = []
    for keys in (["token"], ["token", "kind"]):
        centre = weighed.groupBy(*keys).agg(F.max(F.struct("lists", "doc_id", "n")).alias("centre"))
        met = weighed.join(centre, keys).filter("doc_id <> centre.doc_id")
        near = (100 * F.col("centre.n") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("centre.n"))
        times = met.filter(near).groupBy("doc_id", F.col("centre.doc_id").alias("other")).agg(F.count(F.lit(1)).alias("times"))
        best = times.groupBy("doc_id").agg(F.max(F.struct("times", "other")).alias("best"))
        out.append(best.select(F.least("doc_id", "best.other").alias("a"), F.greatest("doc_id", "best.other").alias("b")))
    return out[0].unionByName(out[1])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size: the bit of the hash of every id is set. It lets other ids pass
    too; it only spares most rows the way through a later join."""
    places = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the wanted ids, and of a few others; texts do not move for that."""
    passing = id_filter(ids)
    placed = docs.filter("doc_id IS NOT NULL").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            keep = (passing[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    return placed.mapInArrow(task, "doc_id long, text string")


def linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity, compared exactly. ``pairs`` is a
    written table; only the texts of its ids are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(wanted(docs, ids), "texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in cut_batches(cut_batches(iter([batch]), "x", SLICE_BYTES), "y", SLICE_BYTES):
                # The rows of one b lie together: its set is made once for a run of one text.
                b, y = part.column("b").to_numpy(), part.column("y")
                other = pc.not_equal(y.slice(1), y.slice(0, len(y) - 1)).to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], (b[1:] != b[:-1]) | other])
                ys = shingle_sets(part.column("y").filter(pa.array(new)), powers)
                keep = []
                for u, at in zip(shingle_sets(part.column("x"), powers), np.cumsum(new) - 1, strict=True):
                    v = ys[at]
                    merged = np.concatenate([u, v])
                    merged.sort()
                    common = int((merged[1:] == merged[:-1]).sum())
                    keep.append(len(merged) > 0 and 100 * common >= percent * (len(merged) - common))
                chosen = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(chosen), part.column("b").filter(chosen)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(task, "a long, b long").distinct()


def bitmap(values: np.ndarray, per_token: int = 8) -> np.ndarray:
    """The token bitmap of a set: ``per_token`` to twice as many bits for each token, a power of two
    in all."""
    bits = 64 << max(0, int(per_token * len(values) - 1).bit_length() - 6)
    place = (values >> np.uint64(20)) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def bitmaps(docs: DataFrame, ids: DataFrame, per_token: int = 8) -> DataFrame:
    """``doc_id, bits, n``: the token bitmap and the size of the set of each wanted id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in sets_of(batches):
            columns = [own, pa.array([bitmap(s, per_token).tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bits", "n"])

    return wanted(docs, ids).mapInArrow(task, "doc_id long, bits binary, n long").filter("n > 0")


def overlap_bound(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """How many tokens two sets of ``n`` and ``m`` tokens with these bitmaps can share at most: the
    bits that both have, and the tokens that one set can have beyond its bits."""
    words = min(len(x), len(y))
    x, y = folded(x, words), folded(y, words)
    beyond = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
    return min(n, m, int(np.bitwise_count(x & y).sum()) + beyond)


def possible_pairs(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose bitmaps of two to four bits for each token allow the similarity. Sets
    that share a passage alone part here, and their texts need not move. ``pairs`` is a written
    table. Rows that share an id can have several bitmaps; a pair stays if any two allow it."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    signs = written(bitmaps(docs, ids, per_token=2), "pair-bitmaps")
    left = pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("bits").alias("x"), "n"), "a")
    both = left.join(signs.select(F.col("doc_id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "y", "m")), strict=True):
                most = overlap_bound(np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), m)
                keep.append((100 + percent) * most >= percent * (n + m))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    return both.select("a", "b", "x", "n", "y", "m").mapInArrow(task, "a long, b long").distinct()


def shared_prefix(n: Column, m: Column, percent: int) -> Column:
    """How many shingles the prefixes of two sets of these sizes share, at least, if the sets
    reach the similarity.

    The sets share ``o = ceil(t / (1 + t) * (n + m))`` shingles, so ``n - o`` of the first set's
    are not in the second. Of the two prefixes one ends first in the common order, and what it
    shares with the other set lies in that set's prefix."""
    together = F.ceil(percent * (n + m) / (100 + percent))

    def least(size: Column) -> Column:
        return size - F.ceil(percent * size / 100) + 1 - (size - together)

    return F.greatest(F.lit(1), F.least(least(n), least(m)))


def leaf_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets that short lists leave: each list is one leaf of at most
    ``LEAF`` sets, the leaves that a pair shares are counted, and their number and the sizes must
    allow the similarity. Pairs that share a longer list too are found by its tree."""
    members = lists.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("leaf"))
    first = members.select("leaf", F.posexplode("leaf").alias("at", "x"))
    pairs = first.select("x", F.explode(F.slice("leaf", F.col("at") + 2, F.lit(LEAF))).alias("y"))
    close = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    counted = pairs.filter(close).groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter(F.col("shared") >= shared_prefix(F.col("n"), F.col("m"), percent)).select("a", "b").filter("a <> b")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at a smaller width; a bit is set if any bit that falls on it is."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Tree:
    """A signature tree over up to ``TREE`` sets in ascending size: levels of nodes from the
    single sets up to the root, ``LEAF`` children to a node."""

    def __init__(self, n: np.ndarray, group: np.ndarray, bits: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [{"low": n, "high": n, "excess": excess, "first": group, "last": group, "bits": bits}]
        while len(self.levels[-1]["low"]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below["low"]), LEAF)
            self.levels.append(
                {
                    "low": np.minimum.reduceat(below["low"], at),
                    "high": np.maximum.reduceat(below["high"], at),
                    "excess": np.maximum.reduceat(below["excess"], at),
                    "first": np.minimum.reduceat(below["first"], at),
                    "last": np.maximum.reduceat(below["last"], at),
                    "bits": np.bitwise_or.reduceat(below["bits"], at, axis=0),
                }
            )

    def level(self, k: int) -> dict[str, np.ndarray]:
        return self.levels[min(k, len(self.levels) - 1)]


def possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set below node i of x can be linked with, and is not yet connected to, some
    set below node j of y. The overlap is at most the bits that both nodes have, and the tokens
    that one set can have beyond its bits; it has to be t / (1 + t) of both sizes together, and
    t of the larger one."""
    open_ = ~((x["first"][i] == x["last"][i]) & (y["first"][j] == y["last"][j]) & (x["first"][i] == y["first"][j]))
    near = (100 * x["high"][i] >= percent * y["low"][j]) & (100 * y["high"][j] >= percent * x["low"][i])
    out = open_ & near
    i, j = i[out], j[out]
    most = np.empty(len(i), np.int64)
    step = max(1, (1 << 21) // max(1, x["bits"].shape[1]))
    for lo in range(0, len(i), step):
        most[lo : lo + step] = np.bitwise_count(x["bits"][i[lo : lo + step]] & y["bits"][j[lo : lo + step]]).sum(axis=1, dtype=np.int64)
    most += np.minimum(x["excess"][i], y["excess"][j])
    most = np.minimum(most, np.minimum(x["high"][i], y["high"][j]))
    enough = (100 + percent) * most >= percent * (x["low"][i] + y["low"][j])
    enough &= 100 * most >= percent * np.maximum(x["low"][i], y["low"][j])
    out[out] = enough
    return out


def surviving(x: Tree, y: Tree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets that the traversal of both trees leaves."""
    top = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        below, beside = x.level(k), y.level(k)
        keep = possible(below, i, beside, j, percent)
        if same:
            keep &= i <= j if k else i < j
        i, j = i[keep], j[keep]
        if k:
            i, j = children(i, k - 1, x), children(j, k - 1, y)
            width_i, width_j = (i[1] - i[0]), (j[1] - j[0])
            pairs = width_i * width_j
            nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            wide = np.repeat(width_j, pairs)
            i, j = np.repeat(i[0], pairs) + nth // np.maximum(wide, 1), np.repeat(j[0], pairs) + nth % np.maximum(wide, 1)
    return i, j


def children(nodes: np.ndarray, k: int, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """First child, and the one after the last, of nodes of level k + 1 at level k."""
    if k + 1 >= len(tree.levels):
        return nodes, nodes + 1
    return nodes * LEAF, np.minimum(nodes * LEAF + LEAF, len(tree.levels[k]["low"]))


def forest_pairs(lists: DataFrame, groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets in different components that the signature trees of all lists
    leave, each once.

    ``lists`` has ``token, n, doc_id``, ``groups`` the component of ids that have one. Lists of
    one component are done; lists of the same sets are traversed once. A list of more than
    ``TREE`` sets makes several trees, and a pair of trees is set up only if sizes and
    components allow a link; so a task holds two trees at most. A tree has sets of one size
    class, so that their bitmaps have about one width."""
    known = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("known"))
    entries = lists.join(known, "doc_id", "left").select("token", "n", "doc_id", F.coalesce("known", "doc_id").alias("component"))
    entries = written(entries, "list-entries")
    members = [F.bit_xor(F.xxhash64(F.lit(k), F.col("doc_id"))).alias(f"members_{k}") for k in (0, 1)]
    summary = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), *members)
    several = summary.filter("low <> high").groupBy("size", "members_0", "members_1").agg(F.min("token").alias("token")).select("token")
    order = Window.partitionBy("token", "kind").orderBy("n", "doc_id")
    numbered = entries.join(several, "token", "left_semi").withColumn("kind", size_class(percent))
    numbered = numbered.withColumn("tree", F.col("kind") * (1 << 40) + F.floor((F.row_number().over(order) - 1) / TREE)).drop("kind")
    numbered = written(numbered, "tree-entries")
    trees = numbered.groupBy("token", "tree").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("first"), F.max("component").alias("last"))
    x, y = trees.alias("x"), trees.alias("y")
    pairs = x.join(y, F.expr(f"x.token = y.token AND x.tree <= y.tree AND 100 * x.high >= {percent} * y.low AND NOT (x.first = x.last AND y.first = y.last AND x.first = y.first)"))
    pairs = pairs.select("x.token", F.col("x.tree").alias("i"), F.col("y.tree").alias("j"))
    sides = pairs.select("token", F.col("i").alias("tree"), "i", "j").unionByName(pairs.filter("i < j").select("token", F.col("j").alias("tree"), "i", "j"))
    signatures = written(bitmaps(docs, numbered.select("doc_id").distinct()).drop("n"), "bitmaps")
    rows = numbered.join(sides, ["token", "tree"]).join(signatures, "doc_id")
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j", "tree", "n", "doc_id")
    dealt = dealt.select("token", "i", "j", "tree", "n", "doc_id", "component", "bits")

    def tree_of(rows: dict[str, np.ndarray], bits: list[np.ndarray], words: int) -> Tree:
        return Tree(rows["n"], rows["component"], np.stack([folded(b, words) for b in bits]))

    def traverse(rows: dict[str, np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        words = min(len(b) for b in bits)
        second = int(np.searchsorted(rows["tree"], rows["j"][0])) if rows["i"][0] != rows["j"][0] else 0
        if second:
            first = tree_of({k: v[:second] for k, v in rows.items()}, bits[:second], words)
            i, j = surviving(first, tree_of({k: v[second:] for k, v in rows.items()}, bits[second:], words), False, percent)
            j = j + second
        else:
            own = tree_of(rows, bits, words)
            i, j = surviving(own, own, True, percent)
        a, b = rows["doc_id"][i], rows["doc_id"][j]
        apart = rows["component"][i] != rows["component"][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart])], names=["a", "b"])

    names = ("token", "i", "j", "tree", "n", "doc_id", "component")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, np.ndarray], list[np.ndarray]]] = []

        def whole() -> pa.RecordBatch:
            rows = {k: np.concatenate([r[k] for r, _ in held]) for k in names}
            bits = [b for _, part in held for b in part]
            held.clear()
            return traverse(rows, bits)

        for batch in batches:
            rows = {k: batch.column(k).to_numpy() for k in names}
            bits = [np.frombuffer(v.as_buffer(), np.uint64).copy() for v in batch.column("bits")]
            key = np.stack([rows["token"], rows["i"], rows["j"]])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), len(bits)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[-1][0][k][-1] != rows[k][lo] for k in ("token", "i", "j")):
                    yield whole()
                held.append(({k: v[lo:hi] for k, v in rows.items()}, bits[lo:hi]))
        if held:
            yield whole()

    return dealt.mapInArrow(task, "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Sets hold the distinct runs of five words of the whole text, A-Z lower-cased; a shorter text
    is one shingle. Texts are linked when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id that links lead to. A null, empty or blank text has no
    shingles and no links. Rows that share an id are one document for the links, each with its
    own size; rows without an id are answered without a component and take no part. An empty
    table gives an empty result; other columns are ignored.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(shingle_rows(docs), "shingle-rows")
    sizes = rows.filter("n IS NOT NULL")
    classes = sizes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))

    frequent = frequent_shingles(rows)
    lists = written(shared_lists(postings(docs, frequent, percent), percent), "shared-lists")
    short = lists.filter(F.col("size") <= LEAF).select("token", "n", "doc_id")
    long = lists.filter(F.col("size") > LEAF)

    first_pairs = written(leaf_pairs(short, percent).unionByName(central_pairs(long, percent)).distinct(), "first-pairs")
    likely = written(possible_pairs(first_pairs, docs, percent), "likely-pairs")
    first_links = written(linked(likely, docs, percent), "first-links")
    groups = written(connected_components(first_links), "first-components")

    rest = written(forest_pairs(long.select("token", "n", "doc_id"), groups, docs, percent), "tree-pairs")
    copies = sizes.join(classes, "key").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).filter("a <> b")
    links = first_links.unionByName(linked(rest, docs, percent)).unionByName(copies)
    components = written(connected_components(links), "components")
    named = components.select(F.col("id").alias("doc_id"), F.col("component").alias("found"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
