"""Documents packed into training sequences under several limits at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value, slices
from trainlake.llm.tokens import END_ID, WordEncoder, word_bpe_path

ship_by_value(__name__)

TASK_BITS = 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, pieces of documents, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    open_sequences: int = 48


@dataclass
class Piece:
    """``ids`` is a part of a document from its token ``start`` on; ``loss`` marks the tokens."""

    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss_from: int
    offset: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:length], self.doc_tokens, self.loss_from)
        return head, Piece(self.doc, self.start + length, self.ids[length:], self.doc_tokens, self.loss_from)

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest head with at most so many tokens and loss-bearing tokens."""
        plain = max(0, min(len(self.ids), self.loss_from - self.start))
        return min(len(self.ids), tokens, plain + loss)


@dataclass
class Packer:
    """Vector bin packing with the dot-product heuristic over a bounded set of open sequences.

    A piece goes to the open sequence with the largest dot product of the piece's needs and the
    room left, each as a share of its limit, among those where all three limits hold. Where none
    has room, a new sequence is opened; with all of them open, the piece is cut to fill the one
    with the most room. ``emit`` gets the sequences as they are closed.
    """

    limits: Limits
    emit: Callable[[list[Piece]], None]
    bins: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        self.room = np.zeros((0, 3))

    def add(self, piece: Piece) -> None:
        """What fills a sequence alone, or is all that one may hold, is cut off first; the rest is
        placed."""
        while (most := piece.fitting(self.limits.tokens, self.limits.loss)) == self.limits.tokens or most < len(piece.ids):
            head, piece = piece.cut(most)
            self.emit([head])
        if len(piece.ids):
            self.place(piece)

    def place(self, piece: Piece) -> None:
        while len(piece.ids):
            need = np.array([len(piece.ids), 1, piece.loss], np.float64)
            open_to = (self.room >= need).all(axis=1)
            if open_to.any():
                score = (self.room / self.full) @ (need / self.full)
                return self.put(int(np.where(open_to, score, -1.0).argmax()), piece)
            if len(self.bins) < self.limits.open_sequences:
                self.bins.append([])
                self.room = np.vstack([self.room, self.full])
                if (self.full >= need).all():
                    return self.put(len(self.bins) - 1, piece)
            piece = self.fill(piece)

    def fill(self, piece: Piece) -> Piece:
        """Cuts ``piece`` to fill the sequence with the most room; one that cannot take even one
        token is closed. Returns the rest."""
        usable = (self.room[:, 1] >= 1) & (self.room[:, 0] >= 1)
        best = int(np.where(usable, self.room[:, 0], -1.0).argmax())
        length = piece.fitting(int(self.room[best, 0]), int(self.room[best, 2])) if usable[best] else 0
        if length == 0:
            self.close(best)
            return piece
        head, rest = piece.cut(length)
        self.put(best, head)
        return rest

    def put(self, at: int, piece: Piece) -> None:
        piece.offset = int(self.limits.tokens - self.room[at, 0])
        self.bins[at].append(piece)
        self.room[at] -= [len(piece.ids), 1, piece.loss]
        if self.room[at, 0] == 0 or self.room[at, 1] == 0:
            self.close(at)

    def close(self, at: int) -> None:
        pieces = self.bins.pop(at)
        self.room = np.delete(self.room, at, axis=0)
        if pieces:
            self.emit(pieces)

    def finish(self) -> None:
        """Fills the open sequences, fullest first, from the emptiest one, so that about one is
        left unfilled."""
        while len(self.bins) > 1:
            source = int(self.room[:, 0].argmax())
            pieces = self.bins.pop(source)
            self.room = np.delete(self.room, source, axis=0)
            for no, piece in enumerate(pieces):
                while len(piece.ids) and self.bins:
                    piece = self.fill(piece)
                if len(piece.ids):
                    self.bins.append([])
                    self.room = np.vstack([self.room, self.full])
                    for left in [piece, *pieces[no + 1 :]]:
                        self.put(0, Piece(left.doc, left.start, left.ids, left.doc_tokens, left.loss_from))
                    break
        if self.bins:
            self.close(0)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(
    docs: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, loss_tokens,
    sequence_id, offset``.

    A document is the ids of its whole text and the end id; a null text is empty and gives the
    end id alone. ``loss_from_col`` names the token from which on a row bears loss (a prompt
    comes before it); null or no column means all of it. Repeated rows are packed each. An empty
    table gives no pieces; other columns are ignored.

    Every task packs its own rows as they stream through, with a bounded number of sequences
    open, so nothing is shuffled. A sequence id is the task's number and a running number; a
    task that runs again reads the same rows and makes the same sequences. At its end a task
    fills its open sequences from each other and leaves about one unfilled.
    """
    path = tokenizer or word_bpe_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        first = TaskContext.get().partitionId() << TASK_BITS
        out: list[tuple] = []
        closed = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal closed
            for p in pieces:
                out.append((p.doc, p.start, len(p.ids), crc32(p.ids), p.doc_tokens, p.loss, first + closed, p.offset))
            closed += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = [f.split()[0] for f in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            out.clear()
            return batch

        packer = Packer(limits, emit)
        for part in slices(batches, "text"):
            ids, ends = encoder.encode(part.column("text"), END_ID)
            loss_from = part.column("loss_from").to_pylist()
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                own = ids[ends[k] : ends[k + 1]]
                packer.add(Piece(doc, 0, own.copy(), len(own), loss_from[k] or 0))
            if out:
                yield rows()
        packer.finish()
        if out:
            yield rows()

    loss = col(loss_from_col).cast("long") if loss_from_col else F.lit(None).cast("long")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), loss.alias("loss_from"))
    return rows.mapInArrow(task, PIECES)
