"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment scores them.

Seeds are the runs of ``SEED`` words of a test item that are rare: the product of their words' shares
of the corpus is at most ``SEED_RATE``. That is how often chance would make them, and it stays small
for a passage that is copied into many documents. Of an item with few rare runs, the rarest quarter
are seeds in any case. Seeds that a document shares with an item mark a stretch of the document; the
item is aligned with that stretch (match 2, mismatch and gap -1 a word), so edited, cut or
paraphrased copies score in proportion. The score is the alignment's value over that of the whole
item; a document is contaminated when it reaches ``LEAST_SCORE`` and an alignment worth ``LEAST_WORDS``
matching words (or the whole item, if shorter), or with an alignment worth ``EXCERPT_WORDS`` matching
words, however long the item is.

Scale: the test items do not grow with the corpus, yet their size is checked: they go in blocks of at
most about ``BLOCK_CHARS`` characters, each block is broadcast and all rows are searched against it,
in whole texts. Documents are read once for word shares and once for each block; nothing is shuffled
but the counts of the items' words.

Defined cases: null or empty texts match nothing; items that are null or have fewer than ``SEED``
words have no seeds and match nothing; equal items are reported each; of equal scores the earliest
stretch counts; repeated rows are searched each. Without documents or items the result is empty.
Null ids pass through. ``matches`` reads the id and the text only; ``drop_contaminated`` keeps all
columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.hash_array import HashArray
from ethospark.llm.text import U64, Words, pieces

SEED, SEED_RATE = 3, 1e-8
MATCH, OTHER = 2, -1  # value of equal words; of a mismatch or a gap
LEAST_SCORE, LEAST_WORDS = 0.5, 8
EXCERPT_WORDS = 20
BLOCK_CHARS = 4_000_000
CELLS = 1 << 21  # of the alignment tables in memory at once


class Items:
    """A block of test items: their words, and their seeds in a sorted array."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids = ids
        words = Words(texts)
        self.hash, self.bounds = words.hash, words.bounds
        self.length = np.diff(words.bounds)
        self.grams, self.first = words.grams(SEED)
        self.item = words.doc[self.first] if len(self.first) else np.zeros(0, np.int64)
        self.vocabulary = HashArray(np.unique(self.hash))

    def choose_seeds(self, counts: np.ndarray, total: int) -> None:
        """Keep the rare runs, given the corpus counts of the vocabulary."""
        share = np.maximum(counts, 0.5) / max(total, 1)
        at = self.vocabulary.find(self.hash)
        rate = np.prod([share[at[self.first + k]] for k in range(SEED)], axis=0) if len(self.first) else np.zeros(0)
        order = np.lexsort((rate, self.item))
        rank = np.empty(len(order), np.int64)
        begin = np.searchsorted(self.item[order], np.arange(len(self.length)))
        rank[order] = np.arange(len(order)) - begin[self.item[order]]
        keep = (rate <= SEED_RATE) | (rank < (self.length[self.item] + 3) // 4)
        grams, item = self.grams[keep], self.item[keep]
        place = self.first[keep] - self.bounds[item]
        order = np.argsort(grams, kind="stable")
        keys, begin = np.unique(grams[order], return_index=True)
        self.seeds = HashArray(keys)
        self.seed_begin = np.append(begin, len(order))
        self.seed_item, self.seed_place = item[order], place[order]
        del self.grams, self.first, self.item

    def least(self, item: np.ndarray) -> np.ndarray:
        """Value that an alignment with each item must reach."""
        n = self.length[item]
        least = np.maximum(LEAST_SCORE * MATCH * n, MATCH * np.minimum(n, LEAST_WORDS))
        return np.minimum(least, MATCH * EXCERPT_WORDS)

    def stretches(self, words: Words):
        """(row, item, begin, end) of the stretches of words around shared seeds."""
        grams, first = words.grams(SEED)
        found = self.seeds.find(grams)
        first, found = first[found >= 0], found[found >= 0]
        if not len(found):
            return (np.zeros(0, np.int64),) * 4
        n = self.seed_begin[found + 1] - self.seed_begin[found]
        at = np.repeat(self.seed_begin[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, first = self.seed_item[at], np.repeat(first, n)
        row, start = words.doc[first], first - self.seed_place[at]
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        slack = self.length[item] // 4 + 8
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.length[item][1:] // 2 + slack[1:])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(row)) - 1
        row, item, slack = row[heads], item[heads], slack[heads]
        begin = np.maximum(start[heads] - slack, words.bounds[row])
        end = np.minimum(start[tails] + self.length[item] + slack, words.bounds[row + 1])
        return row, item, begin, end

    def search(self, words: Words):
        """(row, item, score, begin, end) of the best alignment of each row and item that is good
        enough; begin and end count the row's words."""
        row, item, begin, end = self.stretches(words)
        value, stop = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        size = end - begin
        order = np.lexsort((self.length[item], size)) if len(row) else np.zeros(0, np.int64)
        at = 0
        while at < len(order):  # tables of about equal width
            till = at + 1
            while till < len(order) and size[order[till]] <= size[order[at]] * 2 and (till - at + 1) * size[order[till]] <= CELLS:
                till += 1
            these = order[at:till]
            value[these], stop[these] = self._align(words, item[these], begin[these], end[these])
            at = till
        good = np.flatnonzero(value >= self.least(item))
        row, item, begin, value, stop = row[good], item[good], begin[good], value[good], stop[good]
        best = np.lexsort((begin, -value, item, row))
        first = np.ones(len(best), bool)
        first[1:] = (row[best][1:] != row[best][:-1]) | (item[best][1:] != item[best][:-1])
        best = best[first]
        row, item, begin, value, stop = row[best], item[best], begin[best], value[best], stop[best]
        # the same alignment read backwards ends where it begins
        ends = begin + stop
        back = np.zeros(len(row), np.int64)
        for i in range(len(row)):
            back[i] = self._align(words, item[i : i + 1], begin[i : i + 1], ends[i : i + 1], -1)[1][0]
        base = words.bounds[row]
        return row, item, value / (MATCH * np.maximum(self.length[item], 1)), ends - back - base, ends - base

    def _align(self, words: Words, item, begin, end, step: int = 1):
        """(value, words up to its end) of the best local alignment of each item with its stretch."""
        rows, wide, long = len(item), int((end - begin).max()), int(self.length[item].max())
        text = np.zeros((rows, wide), U64)
        test = np.ones((rows, long), U64)
        for i in range(rows):
            own = words.hash[begin[i] : end[i]][::step]
            text[i, : len(own)] = own
            own = self.hash[self.bounds[item[i]] : self.bounds[item[i] + 1]][::step]
            test[i, : len(own)] = own
        place = np.arange(wide + 1, dtype=np.int32)
        table = np.zeros((rows, wide + 1), np.int32)
        best, stop = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for k in range(long):
            step_value = np.where(text == test[:, k : k + 1], MATCH, OTHER).astype(np.int32)
            now = np.zeros_like(table)
            np.maximum(table[:, :-1] + step_value, table[:, 1:] + OTHER, out=now[:, 1:])
            np.maximum(now, 0, out=now)
            now = np.maximum.accumulate(now - OTHER * place, axis=1) + OTHER * place  # gaps along the text
            table = now
            top = table.argmax(axis=1)
            value = table[np.arange(rows), top]
            better = value > best
            best[better], stop[better] = value[better], top[better]
        return best, stop


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """The test items, in blocks of bounded size; small tables are one block."""
    items = benchmark.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").toArrow().combine_chunks()
        if block.num_rows:
            yield Items(_single(block.column("id")), _single(block.column("text")))


def _single(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _with_seeds(docs: DataFrame, items: Items) -> None:
    """Choose the block's seeds by the shares of its words in all of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def task(batches):
        vocabulary = sent.value
        counts, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for piece in pieces(batches):
            hashes = Words(piece.column("text")).hash
            counts += np.bincount(vocabulary.find(hashes) + 1, minlength=len(counts))
            total += len(hashes)
        some = np.flatnonzero(counts[1:])
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(counts[1:][some], total))], ["at", "c"])

    found = docs.mapInArrow(task, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    at, c = found.column("at").to_numpy(), found.column("c").to_numpy()
    counts = np.zeros(len(items.vocabulary))
    counts[at[at >= 0]] = c[at >= 0]
    items.choose_seeds(counts, int(c[at < 0].sum()))


def matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item id, score, start_word, end_word): the best alignment of each document and test item
    that counts as contamination."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_column), (benchmark, item_id)))
    schema = f"id {id_kind}, item {item_kind}, score double, start_word long, end_word long"
    result = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id, item_text):
        _with_seeds(rows, items)
        result = result.unionByName(rows.mapInArrow(_finder(docs, items), schema))
    return result.select(F.col("id").alias(id_column), F.col("item").alias(item_id), "score", "start_word", "end_word")


def _finder(docs: DataFrame, items: Items):
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def task(batches):
        for piece in pieces(batches):
            row, item, score, begin, end = sent.value.search(Words(piece.column("text")))
            if len(row):
                yield pa.record_batch(
                    [piece.column("id").take(pa.array(row)), sent.value.ids.take(pa.array(item)), pa.array(score), pa.array(begin), pa.array(end)],
                    ["id", "item", "score", "start_word", "end_word"],
                )

    return task


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that no test item contaminates."""
    left = docs
    for items in _blocks(benchmark, item_id, item_text):
        _with_seeds(docs.select(F.col(text_column).alias("text")), items)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def task(batches, sent=sent):
            for piece in pieces(batches, text_column):
                stays = np.ones(piece.num_rows, bool)
                stays[sent.value.search(Words(piece.column(text_column)))[0]] = False
                yield piece.filter(pa.array(stays))

        left = left.mapInArrow(task, docs.schema)
    return left
