"""Words of whole texts as arrays: the step that the operators on words share.

A word is a run of bytes other than space and TAB..CR (``[^\\x20\\x09-\\x0D]+``); A-Z count as a-z.
Arrow hands over the UTF-8 bytes of a batch as one buffer, so words are found and hashed for many
rows at once. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 18  # bytes of text whose arrays are in memory at once; one text is never cut
_BASE = U64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(kind: str, n: int) -> np.ndarray:
    known = _powers[kind]
    if len(known) < n:
        step = _BASE if kind == "up" else _INVERSE
        grown = np.full(max(n, 2 * PIECE_BYTES), step, U64)
        grown[0] = 1
        known = _powers[kind] = np.multiply.accumulate(grown)
        if n > 8 * PIECE_BYTES:  # a giant text: not kept
            _powers[kind] = known[:PIECE_BYTES].copy()
    return known[:n]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES):
    """The batches in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a slice: ``doc`` (row of the slice), ``start`` and ``end`` (bytes), ``hash``."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        word = ~_SEPARATOR[data]
        first, last = word.copy(), word.copy()
        if len(data):
            inner = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of texts that have any
            follows = word[:-1].copy()
            follows[inner[inner > 0] - 1] = False  # a text's first word begins with it
            first[1:] &= ~follows
            ahead = word[1:].copy()
            ahead[inner[inner > 0] - 1] = False
            last[:-1] &= ~ahead
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _power("up", len(data)), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _power("down", len(data) + 1)[self.start]
        self.hash = mix(value + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))
        #: words of row r are those from bounds[r] to bounds[r + 1]
        self.bounds = np.searchsorted(self.doc, np.arange(self.rows + 1))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every run of ``size`` words inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        value = fold([self.hash[k : n + k] for k in range(size)])
        inside = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return value[inside], inside


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence given as columns; depends on the order."""
    value = np.full(len(columns[0]), len(columns), U64)
    for column in columns:
        value = mix(value * U64(0x2545F4914F6CDD1D) + column)
    return value


def segment_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs of Spark."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
