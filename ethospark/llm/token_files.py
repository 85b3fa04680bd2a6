"""Token files: the ids of all texts in order of their id, as grammars of bounded shards.

``write_tokens`` puts two Parquet tables under a path:

* ``shards``: a row for each run of up to ``SHARD_IDS`` ids, which ends where a text ends if it can. ``part`` (the number of the task that wrote it,
  ascending with the texts), ``first`` (ids of the part before), ``n_ids``; a Re-Pair grammar
  (``repair``): ``base``, ``n_symbols`` and ``symbols``, ``n_rules`` and ``rules`` (left, right, left, …), both as
  ``pack_numbers`` writes them, and ``lengths`` (ids that each rule stands for, little-endian 32 bits) for decoding from
  any position; and the texts that have ids in the shard: ``text_ids``, ``ordinals`` (number in the part),
  ``starts`` (ids of the part before) and ``sizes`` (ids, with the end id).
* ``parts``: ``part``, ``before`` (ids in earlier parts), ``n_ids``.

``read_documents`` decodes them: whole shards, or of wanted texts only the symbols that cover them.

Scale: one range partitioning by id, whose sort spills; a task holds the ids of one shard and of the texts of
one slice. Only a text longer than a shard is cut at shard ends and put together when it is read. Only ``parts``, one row
for each writing task, is numbered in one place and broadcast.

Defined cases: a null or empty text is its end id; null ids are first; rows that share an id are all
written, in the order of the table; an empty table gives empty files and results. Only the id and the text are
read. Strings of special tokens are ordinary text, or with ``special`` those tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.llm.repair import Grammar, compress, pack_numbers, unpack_numbers
from ethospark.llm.text import pieces
from ethospark.llm.token_ids import SLICE_BYTES, TokenIds, with_end

SHARD_IDS = 1 << 20
END_ID = 0
_GRAMMAR = "base int, n_symbols int, symbols binary, n_rules int, rules binary, lengths binary"
_TEXTS = "ordinals array<long>, starts array<long>, sizes array<long>"


class _Part:
    """The ids of one writing task, cut into shards."""

    def __init__(self, part: int, shard_ids: int):
        self.part, self.shard_ids = part, shard_ids
        self.first = self.written = self.count = 0  # ids in shards, ids met, texts met
        self.ids: list[np.ndarray] = []
        self.texts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []  # ids, ordinals, starts, sizes

    def add(self, names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        ordinals = self.count + np.arange(len(names))
        self.texts.append((names, ordinals, self.written + offsets[:-1], np.diff(offsets)))
        self.ids.append(ids)
        self.written += len(ids)
        self.count += len(names)
        while self.written - self.first >= self.shard_ids:
            yield self.shard(self._length())

    def _length(self) -> int:
        """Of the next shard: up to the last text that ends in it, or a cut through a text that no shard holds."""
        ends = np.concatenate([starts + sizes for _, _, starts, sizes in self.texts])
        whole = int(np.searchsorted(ends, self.first + self.shard_ids, "right"))
        return int(ends[whole - 1]) - self.first if whole else self.shard_ids

    def shard(self, n: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        grammar = compress(ids[:n])
        stop = self.first + n
        names = pa.concat_arrays([t[0] for t in self.texts])
        ordinals, starts, sizes = (np.concatenate([t[k] for t in self.texts]) for k in (1, 2, 3))
        inside = int(np.searchsorted(starts, stop))  # texts that begin in this shard or before
        row = {
            "part": self.part, "first": self.first, "n_ids": n, "base": grammar.base,
            "n_symbols": len(grammar.symbols), "symbols": pack_numbers(grammar.symbols),
            "n_rules": len(grammar.rules), "rules": pack_numbers(grammar.rules.ravel()),
            "lengths": grammar.lengths.astype("<u4").tobytes(),
        }
        kinds = {"part": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "base": pa.int32(), "n_symbols": pa.int32(), "n_rules": pa.int32()}
        columns = {k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()}
        texts = {"text_ids": names, "ordinals": pa.array(ordinals), "starts": pa.array(starts), "sizes": pa.array(sizes)}
        columns |= {k: pa.ListArray.from_arrays(pa.array([0, inside], pa.int32()), v[:inside]) for k, v in texts.items()}
        later = int(np.searchsorted(starts + sizes, stop, "right"))  # texts that have ids beyond it
        self.texts = [(names[later:], ordinals[later:], starts[later:], sizes[later:])]
        self.ids, self.first = [ids[n:]], stop
        return pa.RecordBatch.from_pydict(columns)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.written > self.first:
            yield self.shard(self.written - self.first)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID, special: bool = False, shard_ids: int = SHARD_IDS,
) -> None:
    """Writes the files under ``path``, which must not exist."""
    if shard_ids < 1:
        raise ValueError("a shard has at least one id")
    source = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    source = source.withColumn("__place", F.monotonically_increasing_id())  # order of rows that share an id
    order = [F.col("__id").asc_nulls_first(), F.col("__place")]
    kind = source.schema["__id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = _Part(TaskContext.get().partitionId(), shard_ids), TokenIds.load(tokenizer)
        for piece in pieces(batches, "__text", SLICE_BYTES):
            ids, offsets = with_end(*encoder.encode(piece.column("__text"), special), end_id)
            yield from part.add(piece.column("__id"), ids, offsets)
        yield from part.finish()

    shards = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("__place").mapInArrow(
        task, f"part int, first long, n_ids long, {_GRAMMAR}, text_ids array<{kind}>, {_TEXTS}"
    )
    shards.write.parquet(f"{path}/shards")
    spark = docs.sparkSession
    counted = spark.read.schema(shards.schema).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")  # one row per writing task
    counted.select("part", before.alias("before"), "n_ids").write.parquet(f"{path}/parts")


def _grammar(row: dict) -> Grammar:
    rules = unpack_numbers(row["rules"], 2 * row["n_rules"]).reshape(-1, 2)
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    return Grammar(row["base"], rules, lengths, unpack_numbers(row["symbols"], row["n_symbols"]))


_OUT = ["part", "ordinal", "__id", "start", "n_tokens", "at", "ids"]


def _decoded(shards: DataFrame, whole: bool) -> DataFrame:
    """A row for each text and shard: part, ordinal, __id, start (in the part), n_tokens, at (of the piece), ids."""
    kind = shards.schema["text_ids"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("text_ids", "ordinals", "starts", "sizes")}
                names, ordinals, starts, sizes = (batch.column(c)[i].values for c in ("text_ids", "ordinals", "starts", "sizes"))
                first, grammar = row["first"], _grammar(row)
                begin = starts.to_numpy(zero_copy_only=False)
                end = np.minimum(begin + sizes.to_numpy(zero_copy_only=False), first + row["n_ids"]) - first
                begin = np.maximum(begin, first) - first
                if whole:  # texts follow each other without gaps
                    data, offsets = grammar.decode().astype("<u4"), np.append(begin, end[-1:])
                else:
                    parts = [grammar.slice(b, e).astype("<u4") for b, e in zip(begin, end)]
                    data, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(end - begin)])
                ids = pa.Array.from_buffers(
                    pa.large_binary(), len(begin), [None, pa.py_buffer(4 * offsets.astype(np.int64)), pa.py_buffer(data)]
                )
                for k in range(0, len(begin), 4096):
                    here = slice(k, k + 4096)
                    n = len(begin[here])
                    yield pa.record_batch(
                        [pa.array(np.full(n, row["part"], np.int32)), ordinals[here], names[here], starts[here], sizes[here],
                         pa.array(begin[here] + first), ids[here].cast(pa.binary())], _OUT
                    )

    return shards.mapInArrow(task, f"part int, ordinal long, __id {kind}, start long, n_tokens long, at long, ids binary")


def _only_cut(shards: DataFrame) -> DataFrame:
    """``shards`` that hold a text in part, with these texts alone: at most two of a shard."""
    lists = ["text_ids", "ordinals", "starts", "sizes"]
    begins, ends = F.col("first"), F.col("first") + F.col("n_ids")
    cut = F.filter(F.arrays_zip(*lists), lambda t: (t.starts < begins) | (t.starts + t.sizes > ends))
    return shards.withColumn("cut", cut).filter(F.size("cut") > 0).withColumns({c: F.col(f"cut.{c}") for c in lists}).drop("cut")


def read_documents(spark: SparkSession, path: str, id_column: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """One row per text: the id, start (ids of all texts before), n_tokens, ids (little-endian 32 bits).

    With ``wanted`` (a column of ids) only their texts: shards without any are skipped, and in the others only
    the symbols that cover a text are expanded."""
    shards, parts = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/parts")
    if wanted is not None:
        listed = wanted.select(F.col(wanted.columns[0]).alias("__wanted")).distinct()
        text = F.explode(F.arrays_zip("text_ids", "ordinals", "starts", "sizes")).alias("t")
        texts = shards.select("part", "first", text)
        found = texts.join(listed, texts["t.text_ids"].eqNullSafe(listed["__wanted"]), "left_semi")
        lists = found.groupBy("part", "first").agg(F.sort_array(F.collect_list(F.struct("t.ordinals", "t.text_ids", "t.starts", "t.sizes"))).alias("t"))
        lists = lists.select("part", "first", *[F.col(f"t.{c}").alias(c) for c in ("text_ids", "ordinals", "starts", "sizes")])
        shards = shards.drop("text_ids", "ordinals", "starts", "sizes").join(lists, ["part", "first"])
    cut = F.octet_length("ids") < 4 * F.col("n_tokens")
    whole = _decoded(shards, wanted is None).filter(~cut).select("part", "__id", "start", "n_tokens", "ids")
    together = F.aggregate(F.sort_array(F.collect_list(F.struct("at", "ids"))), F.lit(b""), lambda ids, x: F.concat(ids, x.ids))
    put_together = (
        _decoded(_only_cut(shards), False)
        .groupBy("part", "ordinal")
        .agg(F.first("__id").alias("__id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), together.alias("ids"))
    )
    texts = whole.unionByName(put_together.drop("ordinal"))
    return texts.join(F.broadcast(parts.select("part", "before")), "part").select(
        F.col("__id").alias(id_column), (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids"
    )
