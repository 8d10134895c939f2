"""Benchmark decontamination by suffix arrays over the training texts.

1. The words of the test items are numbered. A *block* of items goes to all tasks; blocks are cut
   by the measured size of the benchmark, and each is one pass over the documents.
2. A *shard* is a batch of documents. Its words become the numbers of the test words, 0 for any
   other word, and its suffix array orders all suffixes that begin with a test word: first by
   the leading words packed into one integer, then by prefix doubling among equal ones, up to
   the length of the longest item. A 0 and the end of a document end a suffix.
3. Every suffix of every test item is searched in the array by bisection over packed words. That
   gives its longest verbatim match with a place, and for the first ``window`` words the
   range of all places where they stand.
4. The ranges mark the hit words of each document and the items it has; documents with a hit go.

A shard's memory is bounded by its batch and by the block, whatever the documents repeat: a place
lies in the range of at most one window of each length. Words are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import col, id_and_text, ship_by_value, slices, written
from trainlake.llm.shingles import Powers, word_hashes

ship_by_value(__name__)

WINDOW = 10
#: Bytes of item texts in one block; with the longest item more where an item is that long.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Document and item pairs that are looked at together.
PAIRS = 1 << 21

#: Words are runs of digits, letters and all characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def separated(words: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with a 0 after each text and ``pad`` more at the end, and where each
    text starts in that."""
    n = len(offsets) - 1
    out = np.zeros(len(words) + n + pad, np.int64)
    texts = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(words)) + texts] = words
    return out, offsets[:-1] + np.arange(n)


def packed(words: np.ndarray, bits: int, width: int) -> np.ndarray:
    """At each place the next ``width`` words in one integer, the first in the highest bits; words
    after a 0 count as 0."""
    out = words.copy()
    live = words > 0
    for step in range(1, width):
        ahead = np.zeros(len(words), np.int64)
        ahead[:-step] = words[step:]
        ahead[~live] = 0
        live &= ahead > 0
        out = (out << bits) | ahead
    return out


def runs_of(words: np.ndarray) -> np.ndarray:
    """At each place the number of words up to the next 0."""
    zeros = np.nonzero(words == 0)[0]
    at = np.arange(len(words))
    return zeros[np.searchsorted(zeros, at)] - at


class TestSuffixes:
    """The suffixes of a block of test items and their windows."""

    __test__ = False

    def __init__(self, items: list[str | None], texts: pa.Array, window: int):
        hashes, offsets = word_hashes(texts.fill_null(""), Powers(), WORD_BYTES)
        self.window = window
        self.items = items
        self.vocabulary = np.unique(hashes)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.width = max(1, min(8, 62 // self.bits))
        lengths = np.diff(offsets)
        self.longest = int(lengths.max()) if len(lengths) else 0
        words, starts = separated(np.searchsorted(self.vocabulary, hashes) + 1, offsets, self.longest + self.width + 1)
        self.keys = packed(words, self.bits, self.width)
        self.places = np.nonzero(words)[0]
        self.left = runs_of(words)[self.places]
        self.item = np.repeat(np.arange(len(lengths)), lengths)
        self.start = self.places - starts[self.item]
        self._windows(lengths)

    def _windows(self, lengths: np.ndarray) -> None:
        """Different windows, each with a suffix that begins with it and its items."""
        size = np.minimum(self.window, lengths[self.item])
        own = np.nonzero(self.left >= size)[0]
        seen: dict[bytes, int] = {}
        suffix: list[int] = []
        members: list[list[int]] = []
        for s, n in zip(own.tolist(), size[own].tolist(), strict=True):
            cut = [self.cut(self.keys[self.places[s] + at], n - at) for at in range(0, n, self.width)]
            key = np.array([n, *cut], np.int64).tobytes()
            k = seen.setdefault(key, len(suffix))
            if k == len(suffix):
                suffix.append(s)
                members.append([])
            if not members[k] or members[k][-1] != self.item[s]:
                members[k].append(int(self.item[s]))
        self.window_suffix = np.array(suffix, np.int64)
        self.window_size = size[self.window_suffix]
        # Two items may have one id, and then count once.
        number = {name: k for k, name in enumerate(dict.fromkeys(self.items))}
        self.names = list(number)
        ids = [sorted({number[self.items[i]] for i in m}) for m in members]
        self.window_items = np.array([i for m in ids for i in m], np.int64)
        self.window_ends = np.cumsum([0, *(len(m) for m in ids)])

    def cut(self, key: int, words: int) -> int:
        """A packed key with its first ``words`` words alone."""
        drop = max(0, self.width - words) * self.bits
        return int(key) >> drop << drop

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """The suffix array of a batch of texts over the words of a block of test items."""

    def __init__(self, texts: pa.Array, test: TestSuffixes, powers: Powers):
        hashes, self.offsets = word_hashes(texts.fill_null(""), powers, WORD_BYTES)
        self.test = test
        words, self.starts = separated(test.number(hashes), self.offsets, test.longest + test.width + 1)
        self.keys = packed(words, test.bits, test.width)
        self.array, self.leading = self._sorted(words)

    def _sorted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.nonzero(words)[0]
        keys = self.keys[places]
        order = np.argsort(keys, kind="stable")
        array, keys = places[order], keys[order]
        left = runs_of(words)
        at = np.arange(len(array))
        first = np.ones(len(array), bool)
        first[1:] = keys[1:] != keys[:-1]
        rank = np.zeros(len(words), np.int64)
        rank[array] = np.maximum.accumulate(np.where(first, at, 0)) + 1
        depth = self.test.width
        while depth < self.test.longest:
            tied = ~first
            tied[:-1] |= ~first[1:]
            tied = np.nonzero(tied & (left[array] >= depth))[0]
            if not len(tied):
                break
            pair = (rank[array[tied]] << 32) | rank[array[tied] + depth]
            order = np.argsort(pair, kind="stable")
            array[tied], pair = array[tied][order], pair[order]
            new = np.ones(len(tied), bool)
            new[1:] = pair[1:] != pair[:-1]
            first[tied] = new
            rank[array[tied]] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
            depth *= 2
        return array, keys

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray | int, target: np.ndarray, after: bool) -> np.ndarray:
        """In each range of suffixes that share what precedes, the first whose packed words ``at``
        words further on are not below, or are above, the target."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.nonzero(lo < hi)[0]
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            found = self.keys[self.array[mid] + at]
            below = found <= target[open_] if after else found < target[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def _narrowed(self, lo: np.ndarray, hi: np.ndarray, at: int, key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges cut to the suffixes that have the first ``words`` words of ``key`` at ``at``."""
        drop = (self.test.width - words) * self.test.bits
        low = key >> drop << drop
        high = low | ((1 << drop) - 1)
        if at == 0:
            return np.searchsorted(self.leading, low), np.searchsorted(self.leading, high, side="right")
        return self._bisect(lo, hi, at, low, False), self._bisect(lo, hi, at, high, True)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The range of the places of each different window."""
        test = self.test
        lo = np.zeros(len(test.window_suffix), np.int64)
        hi = np.full(len(lo), len(self.array))
        for at in range(0, test.window, test.width):
            on = np.nonzero((test.window_size > at) & (lo < hi))[0]
            key = test.keys[test.places[test.window_suffix[on]] + at]
            words = np.minimum(test.window_size[on] - at, test.width)
            lo[on], hi[on] = self._narrowed(lo[on], hi[on], at, key, words)
        return lo, hi

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the length of its longest match and a place that has it."""
        test = self.test
        n = len(test.places)
        length, place = np.zeros(n, np.int64), np.full(n, -1)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.array))
        on = np.arange(n) if len(self.array) else np.zeros(0, np.int64)
        at = 0
        while len(on):
            key = test.keys[test.places[on] + at]
            words = np.minimum(test.left[on] - at, test.width)
            new_lo, new_hi = self._narrowed(lo[on], hi[on], at, key, words)
            met = new_lo < new_hi
            full = on[met]
            length[full] = at + words[met]
            place[full] = self.array[new_lo[met]]
            # Where no suffix has all the words, the neighbours of their place share most of them.
            short = np.nonzero(~met)[0]
            for shift in (-1, 0):
                beside = new_lo[short] + shift
                inside = (beside >= lo[on[short]]) & (beside < hi[on[short]])
                some, beside = short[inside], beside[inside]
                differ = self.keys[self.array[beside] + at] ^ key[some]
                shared = sum((differ >> (test.width - w) * test.bits == 0).astype(np.int64) for w in range(1, test.width + 1))
                more = at + np.minimum(shared, words[some])
                better = more > length[on[some]]
                length[on[some[better]]] = more[better]
                place[on[some[better]]] = self.array[beside[better]]
            lo[full], hi[full] = new_lo[met], new_hi[met]
            on = full[test.left[full] > at + test.width]
            at += test.width
        return length, place

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[str | None]]]:
        """For each text the runs of words (first, end) inside windows, and the ids of its items."""
        lo, hi = self.windows()
        n = len(self.starts)
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[str | None]] = [[] for _ in range(n)]
        counts = np.maximum(hi - lo, 0)
        if not counts.sum():
            return runs, items
        window = np.repeat(np.arange(len(counts)), counts)
        places = self.array[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[window]]
        edge = np.zeros(len(self.keys) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + self.test.window_size[window], -1)
        covered = np.concatenate([[False], np.cumsum(edge) > 0, [False]])
        firsts = np.nonzero(covered[1:] & ~covered[:-1])[0]
        ends = np.nonzero(~covered[1:] & covered[:-1])[0]
        texts = self.text_of(firsts)
        for t, a, b in zip(texts.tolist(), (firsts - self.starts[texts]).tolist(), (ends - self.starts[texts]).tolist(), strict=True):
            runs[t].append((a, b))
        pairs = np.unique(np.stack([self.text_of(places), window], axis=1), axis=0)
        sizes = np.diff(self.test.window_ends)[pairs[:, 1]]
        # Pairs of a text stay together; a text has at most as many as the block has words.
        begins = np.concatenate([[0], np.nonzero(np.diff(pairs[:, 0]))[0] + 1])
        total = np.add.reduceat(sizes, begins)
        part = np.cumsum(total) // PAIRS
        for p in np.unique(part).tolist():
            chosen = np.nonzero(part == p)[0]
            rows = np.arange(begins[chosen[0]], begins[chosen[-1] + 1] if chosen[-1] + 1 < len(begins) else len(pairs))
            many = sizes[rows]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.test.window_ends[pairs[rows, 1]], many)
            found = np.unique(np.stack([np.repeat(pairs[rows, 0], many), self.test.window_items[at]], axis=1), axis=0)
            for t, i in found.tolist():
                items[t].append(self.test.names[i])
        return runs, items


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestSuffixes]:
    """The test items in blocks of about ``block_bytes`` of text; at least one block."""
    rows = items.select(col(id_col).cast("string").alias("item"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    if n > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "test-items")
    for k in range(n):
        own = (rows.filter(F.col("block") == k) if n > 1 else rows).select("item", "text").toArrow()
        texts = pa.array(own.column("text").to_pylist() or [""], pa.string())
        yield TestSuffixes(own.column("item").to_pylist() or [None], texts, window)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, digest``: rows of one id with one text are alike in all results."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.withColumn("digest", F.md5("text"))


HITS = "doc_id {id}, digest string, n_words long, runs array<struct<first: long, end: long>>, items array<string>"
RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def block_hits(rows: DataFrame, test: TestSuffixes, every: bool) -> DataFrame:
    """The runs of hit words and the items of every row, or of the rows with a hit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text", SHARD_BYTES):
            shard = Shard(part.column("text"), test, powers)
            runs, items = shard.hits()
            columns = [
                part.column("doc_id"),
                part.column("digest"),
                pa.array(np.diff(shard.offsets), pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in r] for r in runs], RUNS),
                pa.array(items, pa.list_(pa.string())),
            ]
            out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_words", "runs", "items"])
            yield out if every else out.filter(pa.array([bool(r) for r in runs]))

    return rows.mapInArrow(task, HITS.format(id=dict(rows.dtypes)["doc_id"]))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, digest, n_words, runs, items``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. ``runs`` are the
    word ranges ``first`` (from 0) to ``end`` (exclusive) that lie inside occurrences of a
    window, in order and apart; ``items`` the ids, as text, of the items with a window in the
    document. A window is ``window`` consecutive words of an item, or a whole shorter item; an
    item without words has none. A null text has no words. Repeated rows and rows without an id
    are answered each; items that share an id are one item; an item without an id counts, as
    null. Empty tables and other columns do not matter.
    """
    rows = numbered(docs, id_col, text_col)
    found, others = None, []
    for test in blocks(items, item_id_col, item_text_col, window, block_bytes):
        out = block_hits(rows, test, every=found is None)
        if found is None:
            found = out
        else:
            others.append(written(out, "block-hits"))
    if not others:
        return found
    more = others[0]
    for other in others[1:]:
        more = more.unionByName(other)
    alike = more.distinct().groupBy("doc_id", "digest")
    more = alike.agg(F.flatten(F.collect_list("runs")).alias("more_runs"), F.flatten(F.collect_list("items")).alias("more_items"))
    theirs = more.select(F.col("doc_id").alias("id"), F.col("digest").alias("sum"), "more_runs", "more_items")
    both = found.join(theirs, found["doc_id"].eqNullSafe(theirs["id"]) & (F.col("digest") == F.col("sum")), "left")
    empty_runs, empty_items = F.array().cast("array<struct<first: bigint, end: bigint>>"), F.array().cast("array<string>")
    runs = F.array_sort(F.concat("runs", F.coalesce("more_runs", empty_runs)))
    # Runs that touch or overlap become one.
    joined = F.expr("""
        aggregate(all_runs, cast(array() as array<struct<first: bigint, end: bigint>>), (acc, r) ->
            if(size(acc) > 0 and element_at(acc, -1).end >= r.first,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, r.end)))),
               concat(acc, array(r))))
    """)
    out = both.withColumn("all_runs", runs).withColumn("items", F.array_distinct(F.concat("items", F.coalesce("more_items", empty_items))))
    return out.select("doc_id", "digest", "n_words", joined.alias("runs"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a window of a test item; columns stay as they are.

    ``options`` as for ``find_contamination``. Every row is judged by its own text, so a row may go
    and another one of the same id stay.
    """
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = found.filter("size(runs) > 0").select("digest").distinct()
    return docs.join(bad, F.md5(F.coalesce(col(text_col), F.lit(""))) == bad["digest"], "left_anti")


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    least: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each test suffix with a match of ``least`` words or more: ``item_id`` (as text),
    ``item_start``, ``n_words`` of its longest verbatim match in any document, and the ``doc_id``
    and ``doc_start`` of one, that with the smallest id and start that the shards report.

    Shards report what they have once per suffix; the longest is found by a combining group.
    """
    rows = numbered(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    out = None
    for test in blocks(items, item_id_col, item_text_col, WINDOW, block_bytes):

        def task(batches: Iterator[pa.RecordBatch], test: TestSuffixes = test) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for part in slices(batches, "text", SHARD_BYTES):
                shard = Shard(part.column("text"), test, powers)
                length, place = shard.longest()
                s = np.nonzero(length >= least)[0]
                texts = shard.text_of(place[s])
                names = pa.array([test.items[i] for i in test.item[s].tolist()], pa.string())
                columns = [names, test.start[s], length[s], part.column("doc_id").take(pa.array(texts)), place[s] - shard.starts[texts]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=["item_id", "item_start", "n_words", "doc_id", "doc_start"])

        found = rows.mapInArrow(task, f"item_id string, item_start long, n_words long, doc_id {kind}, doc_start long")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_start")).alias("best")
    grouped = out.groupBy("item_id", "item_start").agg(best)
    return grouped.select("item_id", "item_start", (-F.col("best.n")).alias("n_words"), "best.doc_id", "best.doc_start")


def digest_items(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_contamination``: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``. Ids are sorted as strings; an item without an id is named by
    the empty string."""
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i, F.lit(""))))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )
