"""Packing: token ids of texts placed into sequences by vector bin packing.

Every piece is a vector of demands: tokens, one segment, loss-bearing tokens. A sequence takes the
pending piece with the greatest dot product of demand and room left, both as shares of the limits,
until none fits; then the room that is left is filled with the head of a pending piece, for texts
may be cut. A sequence that the limits or the end of the data keep below its capacity closes at a
power of two, where no padding is needed; what is beyond goes back to the pending pieces.

Scale: no shuffle. Each task tokenises its rows and packs them from a pool of at most ``POOL``
pending pieces, so memory does not depend on the size of a partition; sequence ids carry the
number of the partition.

Ids are those of the tokenizer file (``token_ids``); strings of its special tokens in a text are ordinary
text, or with ``special`` those tokens, as the tokenizer reads them unless told otherwise.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; an empty
table gives an empty table. Only the id and the text (and ``loss_column``, if given) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.text import pieces
from ethospark.llm.token_ids import TokenIds, with_end

CAPACITY = 1024
POOL = 512
SLICE_BYTES = 4 << 20  # of text that is tokenised at once, or one text
END_ID = 0


class Packer:
    """The sequences of one task. A piece is (doc, start, ids, loss, total); all or none of its tokens bear loss."""

    def __init__(self, first_id: int, capacity: int, max_segments: int, max_loss: int, emit):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_loss = capacity, max_loss
        self.sequence, self.emit = first_id, emit
        slots = POOL + 16
        self.pieces = [None] * slots  # pending pieces, in slots
        self.free = list(range(slots))
        self.there = np.zeros(slots, bool)
        self.demands = np.zeros((slots, 3))  # of each slot: tokens, 1, loss-bearing tokens

    @staticmethod
    def _cut(piece, n: int):
        """The first ``n`` tokens, and the rest."""
        doc, start, ids, loss, total = piece
        return (doc, start, ids[:n], loss, total), (doc, start + n, ids[n:], loss, total)

    @staticmethod
    def _fits(piece, tokens: int, loss: int) -> int:
        """Tokens of the piece's head that respect both limits."""
        return min(tokens, len(piece[2]), loss) if piece[3] else min(tokens, len(piece[2]))

    def add(self, doc, ids: np.ndarray, loss: bool) -> None:
        piece = (doc, 0, ids, loss, len(ids))
        while len(piece[2]) >= self.capacity:
            n = self._fits(piece, self.capacity, self.max_loss)
            if n < self.capacity:
                n = 1 << (n.bit_length() - 1)
            head, piece = self._cut(piece, n)
            self._close([head])
        self._pend((*piece[:2], piece[2].copy(), *piece[3:]))  # a copy: the slice's ids are let go
        if len(self.free) <= 16:
            self._fill(POOL // 2)

    def finish(self) -> None:
        self._fill(0)

    def _pend(self, piece) -> None:
        tokens = len(piece[2])
        if tokens:
            slot = self.free.pop()
            self.pieces[slot] = piece
            self.there[slot] = True
            self.demands[slot] = tokens, 1, tokens if piece[3] else 0

    def _take(self, slot: int):
        self.there[slot] = False
        self.free.append(slot)
        return self.pieces[slot]

    def _close(self, chosen) -> None:
        offset = 0
        for p in chosen:
            self.emit(p, self.sequence, offset)
            offset += len(p[2])
        self.sequence += 1

    def _fill(self, until: int) -> None:
        while len(self.pieces) - len(self.free) > until:
            chosen, rest = [], []
            room = self.limits.copy()
            while True:
                fits = np.flatnonzero(self.there & (self.demands <= room).all(axis=1))
                if not len(fits):
                    break
                best = int(fits[np.argmax(self.demands[fits] @ (room / self.limits**2))])
                room -= self.demands[best]
                chosen.append(self._take(best))
            if room[0] and room[1] and self.there.any():
                longest = int(np.argmax(np.where(self.there, self.demands[:, 0], -1)))
                n = self._fits(self.pieces[longest], int(room[0]), int(room[2]))
                if n:
                    head, tail = self._cut(self._take(longest), n)
                    chosen.append(head)
                    rest.append(tail)
            total = sum(len(p[2]) for p in chosen)
            beyond = 0 if total == self.capacity else total - (1 << (total.bit_length() - 1))
            while beyond:
                last = chosen.pop()
                if len(last[2]) > beyond:
                    head, last = self._cut(last, len(last[2]) - beyond)
                    chosen.append(head)
                rest.append(last)
                beyond -= len(last[2])
            for p in rest:
                self._pend(p)
            self._close(chosen)


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    max_segments: int = 256, max_loss: int | None = None, loss_column: str | None = None, special: bool = False,
) -> DataFrame:
    """One row per piece: the id, start, length, ids (binary, little-endian 32 bits), n_loss,
    doc_tokens, sequence_id, offset. ``loss_column`` (boolean) says whether a text bears loss; all
    do without it. ``max_loss`` limits loss-bearing tokens of a sequence, ``capacity`` by default.
    ``special`` reads strings of special tokens in a text as those tokens."""
    if capacity < 1 or max_segments < 1 or (max_loss is not None and max_loss < 1):
        raise ValueError("limits must be positive")
    most = capacity if max_loss is None else max_loss
    source = docs.select(
        F.col(id_column).alias("__id"), F.col(text_column).alias("__text"),
        (F.coalesce(F.col(loss_column), F.lit(False)) if loss_column else F.lit(True)).alias("__loss"),
    )
    kind = source.schema["__id"].dataType.simpleString()
    names = ["__id", "start", "length", "ids", "n_loss", "doc_tokens", "sequence_id", "offset"]
    schema = f"__id {kind}, start long, length long, ids binary, n_loss long, doc_tokens long, sequence_id long, offset long"

    def task(batches):
        encoder, rows, size = TokenIds.load(tokenizer), [], 0

        def emit(p, sequence, offset):
            nonlocal size
            rows.append((p[0], p[1], len(p[2]), p[2].tobytes(), len(p[2]) if p[3] else 0, p[4], sequence, offset))
            size += 4 * len(p[2]) + 64

        def batch():
            nonlocal size
            columns = list(zip(*rows))
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            rows.clear()
            size = 0
            return made

        packer, id_type = None, None
        for piece in pieces(batches, "__text", SLICE_BYTES):
            if packer is None:
                id_type = piece.column("__id").type
                packer = Packer(TaskContext.get().partitionId() << 33, capacity, max_segments, most, emit)
            ids, offsets = with_end(*encoder.encode(piece.column("__text"), special), END_ID)
            docs_and_loss = zip(piece.column("__id").to_pylist(), piece.column("__loss").to_pylist())
            for (doc, loss), begin, end in zip(docs_and_loss, offsets.tolist(), offsets[1:].tolist()):
                packer.add(doc, ids[begin:end], loss)
                if size > 1 << 21:
                    yield batch()
        if packer:
            packer.finish()
            if rows:
                yield batch()

    return source.mapInArrow(task, schema).withColumnRenamed("__id", id_column)
