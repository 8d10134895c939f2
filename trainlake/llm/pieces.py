"""SentencePiece encoding and decoding on a relational lattice of words and pieces.

A text gets a blank before it and is cut before every run of blanks, around line ends, and where
ASCII signs meet Latin letters or digits. No piece spans such a cut, which the vocabulary is held to,
so each distinct word between cuts is encoded once for all texts. Substrings of a word
up to the longest piece are exploded and equi-joined with the piece table; the pieces found are
the edges of the word's lattice. They stay in order where the word lies, and are folded for many
words at a time:

* ``viterbi``: the path with the best sum of scores, position by position;
* ``merge``: from single characters, the best-scoring edge over two neighbouring pieces is taken
  until none is left. Model files of type BPE mean this; the scores in them are merge ranks.

Characters that are no piece become one byte piece for each of their UTF-8 bytes.

Documents get the ids of their words, put together in order, and are decoded from these ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm.common import id_and_text, ship_by_value, shuffle_partitions, slices, text_bytes, trim_memory, written
from trainlake.llm.shingles import mixed

ship_by_value(__name__)

BLANK = "▁"
WAYS = "viterbi", "merged"
UNKNOWN_PENALTY = 10.0
#: Words of at most so many characters have a lattice, whose masks have 64 bits; longer
#: words are folded by the same rules one by one, in time in proportion to their length.
LONGEST_WORD = 60
#: The start that marks a longer word, and so many first characters of pieces tell their lengths.
LONG, HEAD = 255, 4
#: So many edges are folded at a time, and so many distinct words counted before they are sent on.
FOLDED_EDGES, COUNTED_WORDS = 1 << 17, 1 << 18
#: The words of texts of so many bytes are looked up at once, and so many rows of rare words packed.
NUMBERED_BYTES, PACKED_ROWS = 16 << 20, 1 << 18
#: At most so many of the most frequent words are sent to all tasks; the rest is joined.
FREQUENT_WORDS = 1 << 19
PRIME = (1 << 31) - 1
LATIN, SIGNS = "A-Za-z0-9À-ÖØ-öø-ɏ", r"\x00-\x09\x0B-\x1F!-/:-@\[-`{-\x7F"
#: A run of blanks belongs to what follows it; a cut is made where a Latin letter or a digit and
#: an ASCII sign meet.
WORD = f"▁*(?:[^▁\\n](?!(?<=[{LATIN}])[{SIGNS}]|(?<=[{SIGNS}])[{LATIN}]))*[^▁\\n]|▁+|\\n"
#: The same for texts of nothing else, and what else there is.
PLAIN_WORD = re.compile(f"▁*[{LATIN}]+|▁*[{SIGNS}]+|▁+|\\n")
ANY_WORD, OTHER = re.compile(WORD), re.compile(f"[^{LATIN}{SIGNS}▁\\n]")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as text with their id and score, and the id of byte 0 (the others follow it)."""

    ids: dict[str, int]
    scores: list[float]
    first_byte: int
    texts: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @property
    def unknown_score(self) -> float:
        """The score of a character that is no piece, in single precision like all others."""
        return float(np.float32(min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY))


def vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces of a model file whose pieces do not span the places where texts are cut."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or piece_model_path())
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    spanning = [texts[i] for i in plain if ANY_WORD.findall(texts[i]) != [texts[i]]]
    if spanning:
        raise ValueError(f"pieces that span words: {spanning[:5]}")
    return Vocabulary({texts[i]: i for i in plain}, [model.get_score(i) for i in range(n)], model.piece_to_id("<0x00>"), texts)


def words_of(text: str) -> list[str]:
    """The words of a text, blanks written as in the pieces; joined, they are the text with a
    blank before it."""
    if not text:
        return []
    text = BLANK + text.replace(" ", BLANK)
    return (ANY_WORD if OTHER.search(text) else PLAIN_WORD).findall(text)


def as_list(values: pa.Array | pa.ChunkedArray) -> list:
    """Texts or bytes as a list, many times faster than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist() if isinstance(values, pa.Array) else values.to_numpy().tolist()


def byte_pairs() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte (blank, line end, Latin letter or digit, sign, other), and for two kinds
    in a row (8 * first + second) whether a word begins between them."""
    kinds = np.zeros(256, np.uint8)
    kinds[:128] = 4
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
    kinds[32], kinds[10] = 1, 2
    cuts = np.zeros(64, bool)
    for first in range(5):
        for second in range(5):
            cuts[8 * first + second] = 2 in (first, second) or (second == 1 and first != 1) or {first, second} == {3, 4}
    return kinds, cuts


KINDS, CUTS = byte_pairs()


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``coded_texts`` with the words as a list."""
    words, at, ends = coded_texts(texts)
    return as_list(words), at, ends


def coded_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts without nulls, the number among them of every word in order, and
    the word offsets of the texts: ``words_of`` for many texts at once, on their bytes."""
    plain = pc.replace_substring(texts, BLANK, " ")
    data, offsets = text_bytes(pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, "")))
    kinds = KINDS[data]
    # Latin letters of two bytes, from U+00C0 to U+024F but for two signs.
    wide = np.nonzero((data >= 0xC3) & (data <= 0xC9))[0]
    if len(wide):
        lead, after = data[wide], data[wide + 1]
        wide = wide[~((lead == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (lead == 0xC9) & (after >= 0x90))]
        kinds[wide] = kinds[wide + 1] = 3
    begins = np.zeros(len(data), bool)
    begins[1:] = CUTS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.nonzero(begins)[0]
    bounds = np.append(starts, len(data)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    words = pc.replace_substring(coded.dictionary, " ", BLANK)
    return words, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every distinct word, counted in each task before the shuffle, and dealt
    finely, because a word grows many times in the lattice."""

    def added(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([n for _, n in held]), minlength=len(coded.dictionary))
        return coded.dictionary, n.astype(np.int64)

    def sent(words: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([words.slice(lo, 1 << 16).cast(pa.string()), pa.array(n[lo : lo + (1 << 16)])], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for part in slices(batches, "text"):
            words, at, _ = coded_texts(part.column("text"))
            held.append((words, np.bincount(at, minlength=len(words))))
            if sum(len(words) for words, _ in held) >= 2 * COUNTED_WORDS:
                held = [added(held)]
                if len(held[0][0]) >= COUNTED_WORDS:
                    yield from sent(*held.pop())
        if held:
            yield from sent(*added(held))

    found = docs.select("text").mapInArrow(task, "word string, n long")
    return found.repartition(4 * shuffle_partitions(docs.sparkSession), "word").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    return spark.createDataFrame(pa.table({"piece": list(vocab.ids), "id": pa.array(vocab.ids.values(), pa.int32())}))


def length_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """``head, lengths``: the first ``HEAD`` characters of longer pieces, and the lengths of substrings with
    this head that may be pieces, those below ``HEAD`` included."""
    lengths: dict[str, set[int]] = {}
    for piece in vocab.ids:
        if len(piece) >= HEAD:
            lengths.setdefault(piece[:HEAD], set(range(1, HEAD))).add(len(piece))
    columns = [pa.array(lengths, pa.string()), pa.array(map(sorted, lengths.values()), pa.list_(pa.int32()))]
    return spark.createDataFrame(pa.table(columns, names=["head", "lengths"]))


def lattice(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``edge`` and the other columns of ``words``: the pieces within each word of up to ``LONGEST_WORD``
    characters, and its single characters, which may be no piece. An edge is one number, because
    millions of rows go to Python: 65536 * (id + 1, or 0 for none) + 256 * start + length. A longer word
    is one row with start ``LONG``. The first row of a word alone has the columns of ``words``.

    ``words`` is dealt by word and stays so: the tables of pieces have the size of the vocabulary and
    are broadcast, so the edges of a word follow each other by start and length. Substrings are
    exploded to the lengths that pieces with the same first characters have."""
    pieces = F.broadcast(piece_table(words.sparkSession, vocab))
    heads = F.broadcast(length_table(words.sparkSession, vocab))
    size = F.length("word")
    places = F.when(size <= LONGEST_WORD, F.sequence(F.lit(0), size - 1)).otherwise(F.array(F.lit(LONG)))
    starts = words.select("*", F.explode(places).alias("start"), size.alias("size"))
    starts = starts.withColumn("head", F.substr("word", F.col("start") + 1, F.lit(HEAD))).join(heads, "head", "left")
    lengths = F.when(F.col("start") == LONG, F.array(F.lit(0))).otherwise(F.coalesce("lengths", F.array(*map(F.lit, range(1, HEAD)))))
    parts = starts.select(*words.columns, "start", "size", F.explode(lengths).alias("length"))
    parts = parts.filter((F.col("start") + F.col("length") <= F.col("size")) | (F.col("start") == LONG))
    parts = parts.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("length")))
    found = parts.join(pieces, "piece", "left").filter("id IS NOT NULL OR length <= 1")
    first = (F.col("start") == LONG) | ((F.col("start") == 0) & (F.col("length") == 1))
    edge = F.shiftleft(F.coalesce("id", F.lit(-1)).cast("long") + 1, 16) + 256 * F.col("start") + F.col("length")
    return found.select(*[F.when(first, F.col(c)).alias(c) for c in words.columns], edge.alias("edge"))


def viterbi(of: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which edges are on the path with the best sum of their word; of equal sums, the one whose
    last piece is longer. ``of`` numbers the words; edges lie by word, start and end.

    The edges are taken by their end, those of all words at a time; each place of a word keeps the
    best sum to it and the edge that gives it."""
    best = np.zeros((len(sizes), int(sizes.max()) + 1), np.float32)
    back = np.full(best.shape, -1, np.int64)
    order = np.lexsort((start, of, end))
    bounds = np.searchsorted(end[order], np.arange(1, best.shape[1] + 1))
    for at, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), start=1):
        own = order[lo:hi]
        if not len(own):
            continue
        words = of[own]
        sums = best[words, start[own]] + score[own]
        first = np.nonzero(np.concatenate([[True], words[1:] != words[:-1]]))[0]
        top = np.maximum.reduceat(sums, first)
        met = np.nonzero(sums == np.repeat(top, np.diff(np.append(first, len(own)))))[0]
        met = met[np.concatenate([[True], words[met[1:]] != words[met[:-1]]])]
        best[words[first], at] = top
        back[words[met], at] = own[met]
    taken = np.zeros(len(of), bool)
    words, places = np.arange(len(sizes)), sizes
    while len(words):
        edges = back[words, places]
        taken[edges] = True
        left = start[edges] > 0
        words, places = words[left], start[edges][left]
    return taken


def merge(of: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which edges are left when neighbours have been merged by score, leftmost first among equals.

    Each word has a mask of the places between its pieces. An edge joins two neighbours when the
    mask has its ends and one place between them; each round merges once in every word that can."""
    one = np.uint64(1)
    bit = lambda at: one << at.astype(np.uint64)
    ends = bit(start) | bit(end)
    inner = (bit(end) - bit(start)) & ~bit(start)
    inner &= ~(bit(start) | (bit(start) - one))
    masks = (one << (sizes.astype(np.uint64) + one)) - one
    several = np.nonzero(end - start > 1)[0]
    live = several[np.lexsort((start[several], -score[several], of[several]))]
    while len(live):
        words = of[live]
        mask, ring = masks[words], ends[live]
        within = mask & inner[live]
        # Edges whose ends are gone or that are one piece can never join again.
        open_ = ((mask & ring) == ring) & (within != 0)
        able = np.nonzero(open_ & ((within & (within - one)) == 0))[0]
        if not len(able):
            break
        able = able[np.concatenate([[True], words[able[1:]] != words[able[:-1]]])]
        masks[words[able]] &= ~inner[live[able]]
        # A word without a merge in this round has none left.
        busy = np.zeros(len(sizes), bool)
        busy[words[able]] = True
        live = live[open_ & busy[words]]
    mask = masks[of]
    return ((mask & ends) == ends) & ((mask & inner) == 0)


def long_viterbi(word: str, vocab: Vocabulary) -> list[int]:
    best: list[tuple[np.float32, int, list[int]] | None] = [None] * (len(word) + 1)
    best[0] = (np.float32(0), 0, [])
    longest, unknown = vocab.longest, np.float32(vocab.unknown_score)
    for start in range(len(word)):
        for end in range(start + 1, min(len(word), start + longest) + 1):
            found = vocab.ids.get(word[start:end])
            if found is None and end > start + 1:
                continue
            score = best[start][0] + (unknown if found is None else np.float32(vocab.scores[found]))
            if best[end] is None or score > best[end][0]:
                best[end] = (score, start, bytes_of(word[start:end], vocab) if found is None else [found])
    out, at = [], len(word)
    while at:
        _, at, ids = best[at]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def long_merge(word: str, vocab: Vocabulary) -> list[int]:
    text, after = list(word), list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] < len(word):
            whole = text[left] + text[after[left]]
            if whole in vocab.ids:
                heapq.heappush(heap, (-vocab.scores[vocab.ids[whole]], left, whole))

    for left in range(len(word) - 1):
        offer(left)
    while heap:
        _, left, whole = heapq.heappop(heap)
        if not text[left] or after[left] >= len(word) or text[left] + text[after[left]] != whole:
            continue
        right = after[left]
        text[left], text[right] = whole, ""
        after[left] = after[right]
        if after[left] < len(word):
            before[after[left]] = left
        offer(before[left])
        offer(left)
    return [i for t in text if t for i in ([vocab.ids[t]] if t in vocab.ids else bytes_of(t, vocab))]


def bytes_of(char: str, vocab: Vocabulary) -> list[int]:
    return [vocab.first_byte + b for b in char.encode("utf-8", "surrogatepass")]


def whole_groups(batches: Iterator[pa.RecordBatch], head: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The batches put together to tables of about so many rows, cut before rows that have ``head``,
    and the places of these rows in them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        heads = np.nonzero(table.column(head).is_valid().to_numpy())[0]
        # The last group may go on in the next batch.
        if len(heads) > 1:
            yield table.slice(0, heads[-1]), heads[:-1]
        held = table.slice(heads[-1]).to_batches()
        n = len(table) - int(heads[-1])
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.nonzero(table.column(head).is_valid().to_numpy())[0]


def with_ids(words: pa.Table, ids: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    columns = [words.column(c).combine_chunks() for c in words.column_names]
    return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), *ids], names=[*words.column_names, *names])


def folded(edges: pa.Table, heads: np.ndarray, vocab: Vocabulary, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words whose lattices are here whole, with their other columns and ids by both folds."""
    edge = edges.column("edge").to_numpy()
    start, length, ids = edge >> 8 & 255, edge & 255, (edge >> 16) - 1
    rest = edges.drop_columns(["edge"])
    kind = pa.list_(pa.int32())
    long = start[heads] == LONG
    if long.any():
        table = rest.take(pa.array(heads[long]))
        words = as_list(table.column("word"))
        yield with_ids(table, [pa.array([fold(w, vocab) for w in words], kind) for fold in (long_viterbi, long_merge)], list(WAYS))
    if long.all():
        return
    of = np.repeat(np.cumsum(~long) - 1, np.diff(np.append(heads, len(edges))))
    keep = start != LONG
    start, length, ids, of = start[keep], length[keep], ids[keep], of[keep]
    table = rest.take(pa.array(heads[~long]))
    words = as_list(table.column("word"))
    sizes = np.array([len(w) for w in words], np.int64)
    if (np.bincount(of[length == 1], minlength=len(sizes)) != sizes).any():
        raise RuntimeError("the edges of a word do not follow each other")
    score = np.where(ids < 0, np.float32(vocab.unknown_score), scores[ids]).astype(np.float32)
    out = []
    for fold in (viterbi, merge):
        left = np.nonzero(fold(of, start, start + length, score, sizes))[0]
        own, found = of[left], ids[left]
        unknown = np.nonzero(found < 0)[0]
        if len(unknown):
            spelled = [bytes_of(words[own[k]][start[left[k]]], vocab) for k in unknown]
            times = np.ones(len(found), np.int64)
            times[unknown] = [len(s) for s in spelled]
            found, own = np.repeat(found, times), np.repeat(own, times)
            found[found < 0] = [i for s in spelled for i in s]
        bounds = np.searchsorted(own, np.arange(len(sizes) + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.astype(np.int32))))
    yield with_ids(table, out, list(WAYS))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def encode_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The columns of ``words``, and ``viterbi, merged``: the ids of each word by both folds. Words
    are dealt by word and come once."""
    return checked_words(words, vocab).drop("same")


def checked_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The columns of ``words``, ``viterbi, merged`` as by ``encode_words``, and ``same``: 1 where the ids
    decode to the word by either way, else 0. Words are decoded where they are folded, so that ids
    do not go to Python again and a task has one worker for both."""
    scores = np.array(vocab.scores, np.float32)
    raw = piece_bytes(vocab)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(raw, pa.large_binary())
        for edges, heads in whole_groups(batches, "word", FOLDED_EDGES):
            for coded in folded(edges, heads, vocab, scores):
                wanted = coded.column("word").cast(pa.large_string()).cast(pa.large_binary())
                same = [pc.equal(decoded(coded.column(way), pieces), wanted) for way in WAYS]
                yield coded.append_column("same", pc.and_(*same).cast(pa.int32()))
        trim_memory()

    return lattice(words, vocab).mapInArrow(task, f"{ddl(words)}, viterbi array<int>, merged array<int>, same int")


def decoded(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The bytes that each list of ids without nulls stands for."""
    ids, ends = lists_of(lists)
    found, cuts = joined(pieces.take(pa.array(ids)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cuts[ends]), pa.py_buffer(found)])


def joined(values: pa.Array | pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """Binary values, nulls as empty, put together, and their bounds in that."""
    whole = pc.fill_null(values, b"")
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    data, offsets = text_bytes(whole)
    return data.tobytes(), offsets


def piece_bytes(vocab: Vocabulary) -> list[bytes]:
    """What each id stands for; control and unknown ids for nothing."""
    return [bytes([i - vocab.first_byte]) if vocab.first_byte <= i < vocab.first_byte + 256 else (t.encode() if vocab.ids.get(t) == i else b"") for i, t in enumerate(vocab.texts)]


def decode(ids: DataFrame, vocab: Vocabulary, key: str = "word", ids_col: str = "ids") -> DataFrame:
    """``key, text`` from ``key, ids``: pieces by an equi-join on the id, put together in order;
    runs of byte pieces are read as UTF-8. Blanks stay written as in the pieces; ``plain_text``
    makes the text of them. No ids give the empty text, unknown ids nothing."""
    spark = ids.sparkSession
    raw = piece_bytes(vocab)
    table = F.broadcast(spark.createDataFrame(pa.table({"id": pa.array(range(len(raw)), pa.int32()), "bytes": pa.array(raw, pa.binary())})))
    placed = ids.select(key, F.posexplode_outer(ids_col).alias("at", "id")).join(table, "id", "left")
    gathered = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("bytes")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.coalesce(p["bytes"], F.lit(""))), ""))
    return gathered.select(key, F.decode(whole, "UTF-8").alias("text"))


def plain_text(pieces: Column) -> Column:
    """The text of decoded pieces: blanks for their sign, without the one set before the text."""
    return F.regexp_replace(F.translate(pieces, BLANK, " "), "^ ", "")


def encode(docs: DataFrame, path: str | None = None, algorithm: str = "merged", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row, by ``algorithm`` "merged" or "viterbi". A null or empty text
    has no ids; repeated rows are answered each; other columns are ignored. Every word of every
    text takes part in the shuffle; ``summarise`` does without."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    vocab = vocabulary(path)
    coded = written(encode_words(word_counts(rows), vocab), "word-pieces").select("word", F.col(algorithm).alias("ids"))
    words = F.regexp_extract_all(F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)), F.lit(WORD), F.lit(0))
    words = F.when(F.col("text") == "", F.expr("CAST(array() AS array<string>)")).otherwise(words)
    placed = rows.select("row", "doc_id", F.posexplode_outer(words).alias("at", "word"))
    joined = placed.join(coded, "word", "left")
    gathered = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return gathered.select("doc_id", F.flatten(F.transform("parts", lambda p: F.coalesce(p["ids"], F.expr("CAST(array() AS array<int>)")))).alias("ids"))


def plain(pieces: str) -> str:
    """``plain_text`` of one text."""
    return pieces.replace(BLANK, " ").removeprefix(" ")


def code_of(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(PRIME))


def frequent_step(table: DataFrame) -> int:
    """The least step, of an eighth power of two of the count, from which on at most
    ``FREQUENT_WORDS`` words lie; no order of all words is needed for it."""
    least, total = 1 << 20, 0
    for step, n in sorted(table.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > FREQUENT_WORDS:
            break
        least = step
    return least


def lists_of(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists without nulls one after the other, and the bounds of the lists."""
    whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], values.type)
    lengths = pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def strung(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` in the order given, as one array and its bounds."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - ends[:-1], lengths)
    at += np.arange(ends[-1])
    return values[at], ends


FIGURES = "code", "merged_code", "same"


def coded_words(words: pa.Table) -> dict:
    """Ids and figures of words as arrays, in their order. Null merges are like the Viterbi path."""
    either = {c: words.column(c) for c in (*WAYS, *FIGURES)}
    for way, other in zip(("merged", "merged_code"), ("viterbi", "code"), strict=True):
        either[way] = pc.coalesce(either[way], either[other])
    out: dict = {c: lists_of(either[c]) for c in WAYS}
    return out | {c: either[c].to_numpy().astype(np.int32) for c in FIGURES}


def packed(value) -> dict:
    """A value to broadcast that lies compressed in files and messages. It is made of built-in types
    and arrays, since broadcasts are read where this package may not be installed."""
    plain = pickle.dumps(value, protocol=5)
    return {"size": len(plain), "data": pa.compress(plain, "zstd", asbytes=True)}


def unpacked(held: dict):
    """The value of a broadcast, unpacked once in each process, which keeps it alone."""
    if "value" not in held:
        held["value"] = pickle.loads(pa.decompress(held.pop("data"), held["size"], "zstd", asbytes=True))
    return held["value"]


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 below 2**32, their low bytes first and their high ones, mostly 0, last."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return struct.pack("<Q", len(values)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked_numbers(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


#: What a rare word takes to each of its blocks, with the names of its columns.
SELDOM = "home", "at", *WAYS, *FIGURES


def packed_words(rare: DataFrame) -> DataFrame:
    """``home, words`` from ``rare`` with the columns ``SELDOM``: what the words of a task have for one
    block as one row. Its numbers are the count, then for each word the place, the length of the Viterbi
    ids, that of the merged ones or 0 for null, the code, that of the merged ids and ``same``; then all ids."""

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("home", "ascending"), ("at", "ascending")])
        home = table.column("home").to_numpy()
        cuts = np.append(np.nonzero(np.append(True, home[1:] != home[:-1]))[0], len(home))
        (best, best_ends), (other, other_ends) = (lists_of(pc.if_else(pc.is_null(c), pa.scalar([], c.type), c)) for c in (table.column(w) for w in WAYS))
        each = [table.column("at").to_numpy(), np.diff(best_ends), np.diff(other_ends), *(pc.fill_null(table.column(c), 0).to_numpy() for c in FIGURES)]
        words = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids = best[best_ends[lo] : best_ends[hi]], other[other_ends[lo] : other_ends[hi]]
            words.append(packed_numbers(np.concatenate([[hi - lo], *(c[lo:hi] for c in each), *ids]).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(home[cuts[:-1]], pa.int64()), pa.array(words, pa.binary())], names=["home", "words"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_ROWS:
                yield together(held)
                held = []
        if sum(b.num_rows for b in held):
            yield together(held)
        held.clear()
        trim_memory()

    return rare.select(*SELDOM).mapInArrow(task, "home long, words binary")


def unpacked_words(packed: list[bytes]) -> dict:
    """``coded_words`` of the words of one block, by their places in it."""
    each: list[list[np.ndarray]] = [[] for _ in range(6)]
    ids: list[list[np.ndarray]] = [[], []]
    for data in packed:
        numbers = unpacked_numbers(data)
        n = int(numbers[0])
        for k, values in enumerate(numbers[1 : 1 + 6 * n].reshape(6, n)):
            each[k].append(values)
        best = 1 + 6 * n + int(each[1][-1].sum())
        ids[0].append(numbers[1 + 6 * n : best])
        ids[1].append(numbers[best:])
    whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    at, best_size, other_size, code, other_code, same = map(whole, each)
    order = np.argsort(at, kind="stable")
    best, other = map(whole, ids)
    # No merged ids are like the Viterbi path.
    best_from, other_from = np.cumsum(best_size) - best_size, len(best) + np.cumsum(other_size) - other_size
    like = other_size == 0
    held = np.concatenate([best, other])
    out = {"viterbi": strung(held, best_from[order], best_size[order])}
    out["merged"] = strung(held, np.where(like, best_from, other_from)[order], np.where(like, best_size, other_size)[order])
    figures = zip(FIGURES, (code, np.where(like, code, other_code), same), strict=True)
    return out | {c: values[order].astype(np.int32) for c, values in figures} | {"at": at[order]}


def rare_words(blocks: DataFrame) -> DataFrame:
    """``block, at, word`` of the rare words of each block. The blocks come with all their columns, so
    that they are shuffled once for this and for ``document_rows``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("rare"), strict=True):
                found = words.values
                for lo in range(0, len(found), 1 << 16):
                    part = found.slice(lo, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(lo, lo + len(part)), pa.int32()), part], names=["block", "at", "word"])

    return blocks.mapInArrow(task, "block long, at int, word string")


def document_blocks(rows: DataFrame, places, kind: str) -> DataFrame:
    """``block, doc_ids, sizes, digests, numbers, own, rare``: documents by the numbers of their words.

    A block has the documents of one slice, or one long document: the numbers of their words, and
    the digests of their texts. Frequent words are numbered from 1; 0 stands for another word, and
    ``own`` has the steps from one such word to the next in the list ``rare``."""
    id_type = pa.string() if kind == "string" else pa.int64()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(places.value)
        block = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.RecordBatch, tuple[pa.Array, np.ndarray, np.ndarray]]] = []
        for part in slices(batches, "text"):
            held.append((part, coded_texts(part.column("text"))))
            if sum(part.column("text").nbytes for part, _ in held) >= NUMBERED_BYTES:
                yield from numbered(held, known, block)
                block += len(held)
                held = []
        if held:
            yield from numbered(held, known, block)

    def numbered(held: list, known: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
        # Each call looks up by a table of all frequent words, so it is made for many slices at once.
        found = pc.index_in(pa.concat_arrays([words for _, (words, _, _) in held]).cast(pa.string()), known)
        found = pc.fill_null(found, -1).to_numpy().astype(np.int64) + 1
        first = 0
        for block, (part, (words, at, ends)) in enumerate(held, start=block):
            number = found[first : first + len(words)]
            first += len(words)
            rare = np.nonzero(number == 0)[0]
            order = np.zeros(len(words), np.int64)
            order[rare] = np.arange(len(rare))
            numbers = number[at]
            met = order[at[numbers == 0]]
            steps = np.diff(met, prepend=0)
            digests = [hashlib.sha256(t).digest() for t in part.column("text").cast(pa.binary()).to_pylist()]
            columns = [[block], [part.column("doc_id").to_pylist()], [np.diff(ends)], [digests], [packed_numbers(numbers)], [packed_numbers(np.where(steps < 0, -2 * steps - 1, 2 * steps))]]
            others = pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), words.take(pa.array(rare)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)), others], schema=fields)

    fields = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("numbers", pa.binary()), ("own", pa.binary()), ("rare", pa.list_(pa.string()))])
    return rows.mapInArrow(task, f"block long, doc_ids array<{kind}>, sizes array<long>, digests array<binary>, numbers binary, own binary, rare array<string>")


def document_rows(blocks: DataFrame, rare: DataFrame, frequent, raw: list[bytes], kind: str) -> DataFrame:
    """One row per document of the blocks, from the ids of the whole document and their decoded text.
    ``rare`` has the rare words as ``packed_words`` gives them."""
    id_type = pa.string() if kind == "string" else pa.int64()
    out = [("doc_id", id_type), *[(c, pa.int64()) for c in ("n_words", "n_pieces", "ids_checksum", "ids_crc32", "n_merged", "merged_checksum", "merged_crc32")], ("round_trip", pa.bool_()), ("text_round_trip", pa.bool_())]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            # The rare words came along for ``rare_words``.
            return rows_of(left.drop_columns(["rare"]), right)
        finally:
            trim_memory()

    def rows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        pieces = pa.array(raw, pa.large_binary())
        often = unpacked(frequent.value)
        seldom = unpacked_words(right.column("words").to_pylist())
        for k in range(left.num_rows):
            row = left.slice(k, 1).to_pylist()[0]
            numbers, steps = unpacked_numbers(row["numbers"]), unpacked_numbers(row["own"])
            met = np.cumsum(np.where(steps % 2, -(steps + 1) // 2, steps // 2))
            if not np.array_equal(seldom["at"], np.arange(met.max(initial=-1) + 1)):
                raise RuntimeError("words of a block are missing")
            # The block's distinct words: the frequent ones in it, then the rare ones.
            seen = np.zeros(numbers.max(initial=0) + 1, bool)
            seen[numbers] = True
            seen[0] = False
            here, at = np.nonzero(seen)[0] - 1, (np.cumsum(seen) - 1)[numbers]
            at[numbers == 0] = len(here) + met
            figures = {c: np.concatenate([often[c][here], seldom[c]]).astype(np.int64) for c in FIGURES}
            sizes = np.array(row["sizes"], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            place = (mixed(np.arange(1, sizes.max(initial=0) + 1, dtype=np.uint64)) % np.uint64(PRIME)).astype(np.int64)
            place = place[np.arange(len(at)) - np.repeat(bounds[:-1], sizes)]
            added = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
            found = {"doc_id": row["doc_ids"], "n_words": sizes, "round_trip": added(1 - figures["same"][at]) == 0}
            same_text = np.ones(len(sizes), bool)
            for way, code, n, checksum, crc in (("viterbi", "code", "n_pieces", "ids_checksum", "ids_crc32"), ("merged", "merged_code", "n_merged", "merged_checksum", "merged_crc32")):
                (ids, ends), (more, more_ends) = often[way], seldom[way]
                ids, ends = strung(ids, ends[here], ends[here + 1] - ends[here])
                ids, ends = np.concatenate([ids, more]).astype("<u4"), np.concatenate([ends, ends[-1] + more_ends[1:]])
                ids, word_ends = strung(ids, ends[at], ends[at + 1] - ends[at])
                ends = word_ends[bounds]
                decoded, cuts = joined(pieces.take(pa.array(ids)))
                cuts = cuts[ends].tolist()
                packed = memoryview(ids.tobytes())
                found[n] = np.diff(ends)
                found[checksum] = added(figures[code][at] * place % PRIME) % PRIME
                found[crc] = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                back = (decoded[a:b].replace(sign, b" ").removeprefix(b" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True))
                same_text &= [hashlib.sha256(t).digest() == d for t, d in zip(back, row["digests"], strict=True)]
            found["text_round_trip"] = same_text
            tables.append(pa.table([pa.array(found[c], t) for c, t in out], names=[c for c, _ in out]))
        return pa.concat_tables(tables) if tables else pa.schema(out).empty_table()

    sign = BLANK.encode()
    types = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return blocks.groupBy("block").cogroup(rare.groupBy("home")).applyInArrow(task, ", ".join(f"{c} {types[t]}" for c, t in out))


def summarise(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_pieces, ids_checksum, ids_crc32, n_merged,
    merged_checksum, merged_crc32, round_trip, text_round_trip``.

    ``n_pieces`` and ``ids_checksum`` are of the Viterbi path, ``n_merged`` and
    ``merged_checksum`` of the merges. A checksum adds, modulo 2**31 - 1, for each word the hash
    of its ids times a hash of its place in the text, so it depends on all ids and their order.
    The crc32 are of the ids of the whole document as little-endian unsigned 32-bit integers.
    ``round_trip`` says that the ids of each word decode to the word by either way, and
    ``text_round_trip`` that the ids of the whole document, decoded and made plain text, give the
    whole text by either way; a text with the sign for blanks in it comes back with blanks.
    A null or empty text has zeros and true; repeated rows are answered each; an empty table gives no
    rows; other columns are ignored.

    The most frequent words, at most ``FREQUENT_WORDS``, go to all tasks. Documents are dealt as
    blocks of word numbers; the other words of a block are encoded where they lie by word, and their
    ids come to the block.
    """
    rows = id_and_text(docs, id_col, text_col)
    vocab = vocabulary(path)
    spark = docs.sparkSession
    kind = "string" if dict(rows.dtypes)["doc_id"] == "string" else "long"
    parts = 4 * shuffle_partitions(spark)

    id_list = "array<smallint>" if len(vocab.texts) <= 1 << 15 else "array<int>"

    def figures(words: DataFrame) -> DataFrame:
        # Rows are kept short: merges that are like the Viterbi path are null.
        both = checked_words(words, vocab)
        other = F.col("viterbi") != F.col("merged")
        ids = [F.col("viterbi").cast(id_list).alias("viterbi"), F.when(other, F.col("merged").cast(id_list)).alias("merged")]
        codes = [code_of(F.col("viterbi")).cast("int").alias("code"), F.when(other, code_of(F.col("merged")).cast("int")).alias("merged_code")]
        return both.select(*words.columns, *ids, *codes, "same")

    counted = written(word_counts(rows).select("word", F.floor(8 * F.log2("n")).cast("int").alias("step")), "word-counts")
    # Frequent words are numbered from the most frequent on: small numbers pack well.
    often = counted.filter(F.col("step") >= frequent_step(counted)).repartition(parts, "word")
    top = figures(often).toArrow().sort_by([("step", "descending"), ("word", "ascending")])
    places = spark.sparkContext.broadcast(packed(pa.concat_arrays([pa.array([], pa.string()), *top.column("word").cast(pa.string()).chunks])))
    frequent = spark.sparkContext.broadcast(packed(coded_words(top)))
    blocks = document_blocks(rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"), places, kind).repartition(shuffle_partitions(spark), "block")
    homes = rare_words(blocks).repartition(parts, "word").groupBy("word").agg(F.collect_list(F.struct("block", "at")).alias("homes"))
    rare = figures(homes).select(F.explode("homes").alias("home"), *WAYS, *FIGURES).select(F.col("home.block").alias("home"), F.col("home.at").alias("at"), *WAYS, *FIGURES)
    return document_rows(blocks, packed_words(rare), frequent, piece_bytes(vocab), kind)
