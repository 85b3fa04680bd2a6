"""Vector codes: product quantisation over value dictionaries, exact in integers.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts; every part has a
codebook of up to 256 entries. Vectors are stored in chunks as per-dimension dictionaries: the sorted
distinct integers of a dimension, and for each row the place of its integer among them. To find
the nearest entry, the squared differences of every distinct integer to all entries are tabulated once
per dimension and chunk; the distances of all rows to all entries are gathers of table rows by
dictionary code, added over the dimensions of a part. Each round replaces entries by the floored
mean of their parts (``fit``), and ``encode`` writes the codes.

Scale: the table is read once and written as chunks (two bytes a component); rounds read these. A task
holds one chunk and emits one row per entry, so a round shuffles the codebook's size per task and the
driver receives ``parts * entries`` rows, whatever the number of vectors. A vector or label in a third
of all rows is only counted more often. Sums are exact (decimals).

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; so are,
after the first vector by id (null ids first, then by value), vectors of another length, counted in
``Codebooks.n_other_length``. Repeated rows count each. Fewer vectors than entries give a smaller
codebook; an empty table gives an empty result. Ties go to the lower entry, unused entries stay. A
length that ``parts`` does not divide, and components so large that a squared distance could leave
64 bits (about 2**17 for 256 dimensions), raise. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import stored

CHUNK = 8192  # rows of a chunk; their places in a dictionary fit 16 bits
AT_ONCE = 256  # rows whose distances to all entries are in memory at once
HOT = 64  # labels with more than one row in HOT have their sums broadcast: fewer than HOT rows


@dataclass
class Codebooks:
    entries: np.ndarray  # (parts, entries, width), integers
    scale: int
    n_other_length: int = 0

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors.astype(np.float64) * scale)
    width = max(1, vectors.shape[-1])
    if scaled.size and 4 * width * float(np.abs(scaled).max()) ** 2 >= 2.0**63:
        raise ValueError("components too large for exact 64-bit distances")
    return scaled.astype(np.int64)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def chunked(vectors: DataFrame, dims: int, scale: int = 1024) -> DataFrame:
    """Rows (__id, __label, __vector) → chunks: ids, labels, dictionary sizes, their integers, places.

    ``places`` holds 16-bit numbers, one dimension after the other."""
    id_kind, label_kind = _kind(vectors, "__id"), _kind(vectors, "__label")
    schema = f"ids array<{id_kind}>, labels array<{label_kind}>, sizes array<int>, integers array<long>, places binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(begin, CHUNK)
                n = piece.num_rows
                flat = piece.column("__vector").flatten().to_numpy(zero_copy_only=False)
                rows = _integers(flat.reshape(n, dims), scale)
                found = [np.unique(rows[:, d], return_inverse=True) for d in range(dims)]
                values = np.concatenate([v for v, _ in found]) if dims else np.zeros(0, np.int64)
                places = b"".join(p.astype("<u2").tobytes() for _, p in found)
                yield pa.record_batch(
                    [_one_list(piece.column("__id")), _one_list(piece.column("__label")),
                     _one_list(pa.array([len(v) for v, _ in found], pa.int32())), _one_list(pa.array(values)),
                     pa.array([places], pa.binary())],
                    ["ids", "labels", "sizes", "integers", "places"],
                )

    return vectors.mapInArrow(task, schema)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Chunk:
    """One stored chunk: dictionaries and places per dimension."""

    def __init__(self, sizes: list[int], integers: np.ndarray, places: bytes, rows: int):
        self.dictionaries = np.split(integers, np.cumsum(sizes)[:-1]) if sizes else []
        self.places = np.frombuffer(places, "<u2").reshape(len(sizes), rows)
        self.rows = rows

    def nearest(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every row: arrays (parts, rows)."""
        parts, entries, width = codebooks.shape
        best, error = np.zeros((parts, self.rows), np.int64), np.zeros((parts, self.rows), np.int64)
        for part in range(parts):
            tables = []
            for k in range(width):
                difference = self.dictionaries[part * width + k][:, None] - codebooks[part, :, k]
                tables.append(difference * difference)
            most = sum(int(t.max()) for t in tables)
            if most < 1 << 31:
                tables = [t.astype(np.int32) for t in tables]
            for begin in range(0, self.rows, AT_ONCE):
                here = slice(begin, begin + AT_ONCE)
                n = len(range(*here.indices(self.rows)))
                distance = np.zeros((n, entries), tables[0].dtype if tables else np.int64)
                row = np.empty_like(distance)
                for k, table in enumerate(tables):
                    np.take(table, self.places[part * width + k, here], axis=0, out=row, mode="clip")
                    distance += row
                best[part, here] = at = distance.argmin(axis=1)
                error[part, here] = distance[np.arange(n), at]
        return best, error

    def sums(self, best: np.ndarray, entries: int, width: int) -> np.ndarray:
        """Sums of the components of all rows that an entry is nearest to: (parts, entries, width)."""
        total = np.zeros((len(best), entries, width), np.int64)
        for part, at in enumerate(best):
            for k in range(width):
                d = part * width + k
                # pairs (entry, dictionary place) are counted, then valued: exact at any size of the integers
                size = len(self.dictionaries[d])
                pairs, times = np.unique(at * size + self.places[d], return_counts=True)
                np.add.at(total[part, :, k], pairs // size, times * self.dictionaries[d][pairs % size])
        return total


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            integers = row["integers"].values.to_numpy(zero_copy_only=False)
            sizes = row["sizes"].as_py()
            places = row["places"].as_py()
            yield row, Chunk(sizes, integers, places, row["n_rows"].as_py())


def _round(chunks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored mean of their parts."""
    parts, entries, width = codebooks.shape
    names = ["part", "entry", "n", *[f"s{k}" for k in range(width)]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for _, chunk in _chunks(batches):
            best, _ = chunk.nearest(codebooks)
            total += chunk.sums(best, entries, width)
            counts += np.stack([np.bincount(at, minlength=entries) for at in best])
        part, entry = np.nonzero(counts)
        if len(part):
            sums = [pa.array([str(x) for x in total[part, entry, k]], pa.string()) for k in range(width)]
            yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), *sums], names)

    schema = "part long, entry long, n long" + "".join(f", s{k} string" for k in range(width))
    partial = chunks.select("sizes", "integers", "places", "n_rows").mapInArrow(task, schema)
    sums = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    )
    moved = codebooks.copy()
    for row in sums.collect():  # at most parts * entries rows
        moved[row.part, row.entry] = [int(row[f"s{k}"]) // row.n for k in range(width)]
    return moved


def prepare(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label") -> DataFrame:
    """The usable rows as (__id, __label, __vector)."""
    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    return df.filter(_usable(F.col(vector_column))).select(
        F.col(id_column).alias("__id"), label.alias("__label"), F.col(vector_column).alias("__vector")
    )


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[Codebooks, DataFrame]:
    """Codebooks learnt from rows of ``prepare``, and those rows as stored chunks."""
    first = vectors.orderBy(F.col("__id").asc_nulls_first(), "__vector").select("__vector").limit(entries).collect()
    dims = len(first[0][0]) if first else 0
    if dims % parts:
        raise ValueError(f"{parts} equal parts of {dims} dimensions")
    fitting = vectors.filter(F.size("__vector") == dims)
    chunks = stored(chunked(fitting, dims, scale).withColumn("n_rows", F.size("ids")), "vector-chunks")
    lengths = vectors.agg(F.sum((F.size("__vector") != dims).cast("long"))).first()[0] or 0
    if lengths:
        first = fitting.orderBy(F.col("__id").asc_nulls_first(), "__vector").select("__vector").limit(entries).collect()
    start = _integers(np.array([r[0] for r in first], np.float64).reshape(len(first), dims), scale)
    books = start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    if first:
        for _ in range(rounds):
            books = _round(chunks, books)
    return Codebooks(books, scale, lengths), chunks


def encode(chunks: DataFrame, codebooks: Codebooks) -> DataFrame:
    """One row per vector: __id, __label, code (bytes of entries, one per part), error."""
    id_kind = chunks.schema["ids"].dataType.elementType.simpleString()
    label_kind = chunks.schema["labels"].dataType.elementType.simpleString()
    books = codebooks.entries

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks(batches):
            best, error = chunk.nearest(books)
            codes = np.ascontiguousarray(best.T.astype(np.uint8))
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), chunk.rows, [None, pa.py_buffer(codes)])
            yield pa.record_batch(
                [row["ids"].values, row["labels"].values, fixed.cast(pa.binary()), pa.array(error.sum(axis=0))],
                ["__id", "__label", "code", "error"],
            )

    return chunks.mapInArrow(task, f"__id {id_kind}, __label {label_kind}, code binary, error long")


def error_by_label(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``label_error``, the error summed over equal labels, null labels together.

    Labels with more than one row in ``HOT`` come by broadcast (fewer than ``HOT`` rows), the others by a join."""
    sums = encoded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    total = encoded.count()
    hot = F.col("__n") * HOT > total
    frequent = F.broadcast(sums.filter(hot).select(F.col("__label").alias("__hot"), "label_error"))
    rare = sums.filter(~hot).select(F.col("__label").alias("__rare"), "label_error")
    same = F.col("__label").eqNullSafe(F.col("__hot"))
    warm = encoded.join(frequent, same).drop("__hot")
    cold = encoded.join(frequent, same, "left_anti").join(rare, F.col("__label").eqNullSafe(F.col("__rare"))).drop("__rare")
    return warm.unionByName(cold)


def vector_codes(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[Codebooks, DataFrame]:
    """(codebooks, one row per vector: the id, label, code, error, label_error)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    codebooks, chunks = fit(prepare(df, id_column, vector_column, label_column), parts, entries, rounds, scale)
    encoded = error_by_label(stored(encode(chunks, codebooks), "vector-codes"))
    return codebooks, encoded.select(
        F.col("__id").alias(id_column), F.col("__label").alias("label"), "code", "error", "label_error"
    )
