"""LM scoring: a smoothed word n-gram model as a weighted backoff automaton, log10 scores of texts.

States are the histories of up to two words that occur LEAST times. An arc (state, word), for every
bigram and trigram that occurs LEAST times, carries the interpolated probability with absolute
discount; where a state has no arc for a word, its failure arc leads to the state without the oldest
word and costs the mass that the discounts left over. The root knows every word:
(c + 0.5) / (N + 0.5 (V + 1)), with counts over all training tokens and one end token a text.

A text is scored by one left-to-right traversal that carries the state: it follows failure arcs until a state
has an arc for the next word (the root has one for every word), adds up their log-probabilities and
moves on. The texts of a chunk are traversed side by side; a long text is cut into stretches that begin two
words early, for two words determine the state.

Scale: the model is one distributed table, a row for each word, bigram and trigram with its count and the
discounted counts of its arcs; it grows with the input, and no part of it is in every task. Counts are
added up inside a task before they are shuffled. Texts are taken in chunks, Arrow batches of some BATCH_BYTES: a
chunk asks for its distinct n-grams, one sorted array of keys for each part of the table, and is answered by arrays
in the same order. Texts and answers of a chunk meet in one task, which builds the part of the automaton that the
chunk can reach. A bitmap of 2**FILTER_BITS bits saves questions for most n-grams that are in no table, as
long as it isn't full, and changes no result.

Defined cases: a null or empty text is one end token; repeated rows are scored each; a null id is
in the fold of the empty text; without training rows every token has probability 1. An empty table
gives an empty table. Only the id, the text and ``carry`` are read; they must be deterministic, for
they are read for the questions and again with the answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import BATCH_BYTES, forget, small_batches, stored
from ethospark.llm.hash_array import HashArray, Tally
from ethospark.llm.text import U64, Words, as_long, fold, pieces, segment_sum

LEAST = 2  # occurrences that make a bigram or trigram an arc
CHUNK_BYTES = 2 * BATCH_BYTES  # of text, or one text; at most what an Arrow batch holds
STRETCH = 256  # tokens of a text that are traversed one after the other
PART_NODES = 1 << 18  # rows of the model, or tokens, that one part of the keys has about
FILTER_BITS = 28
DISCOUNT = 0.75
END = np.uint64(0x0E0D0E0D0E0D0E0D)
START = np.uint64(0x57A257A257A257A2)
_THREE = np.full(1, 0x3333333333333333, U64)


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, whether it is the first of its text) of every token, ends included."""
    n = len(words.hash) + words.rows
    rows, hashes, first = np.empty(n, np.int64), np.empty(n, U64), np.zeros(n, bool)
    at = np.arange(len(words.hash)) + words.doc
    rows[at], hashes[at] = words.doc, words.hash
    ends = words.bounds[1:] + np.arange(words.rows)
    rows[ends], hashes[ends] = np.arange(words.rows), END
    first[words.bounds[:-1] + np.arange(words.rows)] = True
    return rows, hashes, first


def bigrams_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each token or START, key of the bigram)."""
    before = np.append(START, hashes[:-1])[: len(hashes)]
    before[first] = START
    return before, fold([before, hashes])


def trigram_key(state: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of the trigram of two bigrams that share a word."""
    return fold([state, last, _THREE])


class Bitmap:
    """Which leading bits keys have (15 of them at least): a fixed size, compressed on its way to the tasks."""

    def __init__(self, keys: DataFrame, leading: int = FILTER_BITS):
        self.leading = leading
        bit = F.shiftrightunsigned("key", 64 - leading) + 1
        found = (
            keys.select(F.bitmap_bucket_number(bit).alias("at"), F.bitmap_bit_position(bit).alias("bit"))
            .groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
        )
        self.bits = np.zeros((1 << leading) // 8, np.uint8)
        for at, bits in zip(found.column("at").to_pylist(), found.column("bits"), strict=True):
            self.bits[(at - 1) * 4096 : at * 4096] = np.frombuffer(bits.as_py(), np.uint8)

    def __getstate__(self):
        return self.leading, len(self.bits), pa.compress(self.bits.tobytes(), "zstd", asbytes=True)

    def __setstate__(self, state):
        self.leading = state[0]
        self.bits = np.frombuffer(pa.decompress(state[2], state[1], "zstd", asbytes=True), np.uint8)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False where a key is not one of those given."""
        bit = keys >> U64(64 - self.leading)
        return (self.bits[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1


class Automaton:
    """The states and arcs that some texts can reach: sorted keys with counts, and the sums of 4 (c - DISCOUNT)
    over the arcs of each state."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sure: np.ndarray, total: int, types: int):
        self.keys = HashArray(keys)
        self.counts, self.sure = np.append(counts, 0).astype(float), np.append(sure, 0) / 4.0
        self.norm = total + 0.5 * (types + 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; the last place stands for keys that are not there."""
        return self.keys.find(keys)  # -1: the last one

    def _fall(self, at: np.ndarray) -> np.ndarray:
        """log10 of the mass left to the failure arc; a state without arcs costs nothing."""
        share = self.sure[at] / np.maximum(self.counts[at], 1)
        return np.where(share > 0, np.log10(np.maximum(1 - share, 1e-12)), 0.0)

    def token_costs(self, words: Words, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, count, log10 at the root, log10 along the automaton) of every token, ends included."""
        rows, hashes, first = sequence(words)
        two = bigrams_of(hashes, first)[1]
        word, arc = self._find(hashes), self._find(two)
        state = np.append(self._find(np.full(1, START)), word[:-1])[: len(word)]
        state[first] = state[:1]
        later = np.flatnonzero(~first)
        count = self.counts[word]
        root = np.log10((count + 0.5) / self.norm)
        has_two = self.counts[arc] >= LEAST
        fall_one = self._fall(state)
        way = fall_one + root
        log_two = np.full(len(rows), -np.inf)
        log_two[has_two] = np.log10((self.counts[arc] - DISCOUNT)[has_two] / self.counts[state][has_two] + 10.0 ** way[has_two])
        # arcs of the state of two words: from the bigram that ends at the token before
        third = np.full(len(rows), -1)
        later = later[has_two[later - 1]]
        both = later[has_two[later]]
        third[both] = self._find(trigram_key(two[both - 1], two[both]))
        has_three = self.counts[third] >= LEAST
        fall_two, own = np.zeros(len(rows)), np.ones(len(rows))
        fall_two[later], own[later] = self._fall(arc[later - 1]), self.counts[arc[later - 1]]
        log_three = np.full(len(rows), -np.inf)
        way = fall_two[has_three] + log_two[has_three]
        log_three[has_three] = np.log10((self.counts[third[has_three]] - DISCOUNT) / own[has_three] + 10.0**way)
        cost = _traverse(np.flatnonzero(first), stretch, has_two, has_three, log_three, fall_two, log_two, fall_one, root)
        return rows, count, root, cost


def _traverse(begins, stretch, has_two, has_three, log_three, fall_two, log_two, fall_one, root) -> np.ndarray:
    """The cost of every token, left to right; ``begins`` are the first tokens of the texts.

    The state is carried as the number of words it remembers: one (the start of a text counts) or two."""
    n = len(root)
    ends = np.append(begins[1:], n)
    cuts = -(-(ends - begins) // stretch)
    number = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    own = np.repeat(begins, cuts) + number * stretch  # the first token that counts
    at = np.where(number > 0, np.maximum(own - 2, np.repeat(begins, cuts)), own)
    left = np.minimum(own + stretch, np.repeat(ends, cuts)) - at
    order = np.argsort(-left, kind="stable")
    at, own, left = at[order], own[order], left[order]
    lanes = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right") if len(left) else []  # still going at each step
    state, cost = np.ones(len(at), np.int8), np.zeros(n)
    for step, going in enumerate(lanes):
        t, remembers = at[:going] + step, state[:going]
        long = remembers == 2
        by_three = long & has_three[t]
        fallen = long & ~by_three
        by_two = ~by_three & has_two[t]
        spent = np.where(fallen, fall_two[t], 0.0) + np.where(by_two, log_two[t], fall_one[t] + root[t])
        spent = np.where(by_three, log_three[t], spent)
        state[:going] = np.where(by_three | by_two, 2, 1)
        counts = t >= own[:going]
        cost[t[counts]] = spent[counts]
    return cost


@dataclass
class Model:
    nodes: DataFrame  # key, c, sure: of every word, the start of a text, every bigram and trigram with an arc
    n_nodes: int
    total: int  # N
    types: int  # V
    arcs: Bitmap  # of the bigrams and trigrams


def _tallied(docs: DataFrame, text_column: str) -> DataFrame:
    """(key, c) of the words and ends of all rows."""

    def task(batches):
        tally = Tally()
        for piece in pieces(batches):
            words = Words(piece.column("text"))
            for done in tally.add(np.concatenate([words.hash, np.full(words.rows, END)])):
                yield from _frames(["key", "c"], *done)
        yield from _frames(["key", "c"], *tally.take())

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(task, "key long, c long")
    return rows.groupBy("key").agg(F.sum("c").alias("c"))


def _frames(names: list[str], *columns: np.ndarray):
    for i in range(0, len(columns[0]), 1 << 18):
        yield pa.record_batch([as_long(x[i : i + (1 << 18)]) for x in columns], names)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, in as many bytes each as the largest one needs."""
    steps = np.diff(keys, prepend=U64(0))
    width = (int(steps[1:].max()).bit_length() + 7) // 8 if len(keys) > 1 else 1
    return keys[:1].tobytes() + bytes([width]) + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, : data[8]] = np.frombuffer(data, np.uint8, offset=9).reshape(n - 1, data[8])
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


def _bits(n: int) -> int:
    """Leading bits of a key that tell its part, for ``n`` rows."""
    return max(8, (n // PART_NODES).bit_length())


def _grams(docs: DataFrame, text_column: str, bits: int, grams_of) -> DataFrame:
    """(key, a, c) of the n-grams that occur LEAST times; ``grams_of`` gives (key, state a) of a slice's words.

    A task sends the n-grams it has counted as one sorted array for each part of the keys."""

    def counted(held):
        keys, states = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        at = _starts(keys)
        counts, states = np.diff(np.append(at, len(keys))), states[order][at]
        keys = keys[at]
        part = (keys >> U64(64 - bits)).astype(np.int64)
        cuts = np.append(_starts(part), len(part))
        rows = [(int(part[i]), int(j - i), _packed_keys(keys[i:j]), states[i:j].tobytes(), _packed(counts[i:j])) for i, j in zip(cuts, cuts[1:])]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "n", "keys", "states", "counts"])

    def task(batches):
        held, n = [], 0
        for piece in pieces(batches):
            held.append(grams_of(Words(piece.column("text"))))
            n += len(held[-1][0])
            if n >= 1 << 20:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    def add_up(arrays: pa.Table) -> pa.Table:
        sizes = arrays.column("n").to_pylist()
        keys = np.concatenate([_unpacked_keys(d, n) for d, n in zip(arrays.column("keys").to_pylist(), sizes)])
        states = np.frombuffer(b"".join(arrays.column("states").to_pylist()), U64)
        counts = np.concatenate([_unpacked(d, n) for d, n in zip(arrays.column("counts").to_pylist(), sizes)])
        order = np.argsort(keys)
        keys = keys[order]
        at = _starts(keys)
        counts = np.add.reduceat(counts[order], at)
        often = counts >= LEAST
        return pa.table([as_long(keys[at][often]), as_long(states[order][at][often]), pa.array(counts[often])], ["key", "a", "c"])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(task, "part long, n long, keys binary, states binary, counts binary")
    return rows.groupBy("part").applyInArrow(add_up, "key long, a long, c long")


def _sure(arcs: DataFrame) -> DataFrame:
    """(key of a state, sum of 4 (c - DISCOUNT) over its arcs), in whole numbers."""
    return arcs.groupBy(F.col("a").alias("key")).agg(F.sum(4 * F.col("c") - int(4 * DISCOUNT)).alias("sure"))


def fit(train: DataFrame, text_column: str = "text", filter_bits: int = FILTER_BITS) -> Model:
    """The model of all rows of ``train``."""
    with small_batches(train.sparkSession):
        return _fit(train, text_column, filter_bits)


def _fit(train: DataFrame, text_column: str, filter_bits: int) -> Model:
    spark, rows = train.sparkSession, train.select(text_column)
    end, start = (int(x.astype(np.int64)) for x in (END, START))
    counts = stored(_tallied(rows, text_column), "lm-words", tidy=True)
    total, types, texts = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("key") == end, F.col("c"))), F.lit(0))
    ).first()

    bits = _bits(total)

    def two(words):
        _, hashes, first = sequence(words)
        before, keys = bigrams_of(hashes, first)
        return keys, before

    bigrams = stored(_grams(rows, text_column, bits, two), "lm-bigrams", tidy=True)
    sent = spark.sparkContext.broadcast(Bitmap(bigrams, filter_bits))

    def three(words):  # both bigrams of a trigram occur as often as it does
        _, hashes, first = sequence(words)
        keys = bigrams_of(hashes, first)[1]
        often = sent.value.maybe(keys)
        at = np.flatnonzero(~first & often & np.append(False, often[:-1])[: len(often)])
        return trigram_key(keys[at - 1], keys[at]), keys[at - 1]

    trigrams = stored(_grams(rows, text_column, bits, three), "lm-trigrams", tidy=True)
    sent.destroy()
    words = counts.union(spark.range(1).select(F.lit(start), F.lit(texts)))
    none = F.lit(0).cast("long").alias("sure")
    nodes = words.join(_sure(bigrams), "key", "left")
    nodes = nodes.unionByName(bigrams.select("key", "c").join(_sure(trigrams), "key", "left"))
    nodes = nodes.unionByName(trigrams.select("key", "c", none)).withColumn("sure", F.coalesce("sure", F.lit(0)))
    nodes = stored(nodes.select("key", "c", "sure"), "lm-nodes", tidy=True)
    arcs = Bitmap(bigrams.select("key").union(trigrams.select("key")), filter_bits)
    for table in (counts, bigrams, trigrams):
        forget(table)
    return Model(nodes, nodes.count(), total, types, arcs)


def _questions(batch: pa.RecordBatch, arcs: Bitmap) -> np.ndarray:
    """Sorted keys of the distinct words, bigrams and trigrams of the texts that may be in the model."""
    return _distinct(np.concatenate([_keys_of(Words(p.column("__text")), arcs) for p in pieces([batch], "__text")]))


def _keys_of(words: Words, arcs: Bitmap) -> np.ndarray:
    _, hashes, first = sequence(words)
    two = bigrams_of(hashes, first)[1]
    often = arcs.maybe(two)
    later = np.flatnonzero(~first & often & np.append(False, often[:-1])[: len(often)])
    three = trigram_key(two[later - 1], two[later])
    return _distinct(np.concatenate([np.append(hashes, START), two[often], three[arcs.maybe(three)]]))


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES, stretch: int = STRETCH,
) -> DataFrame:
    """Per row: the id, ``carry`` columns, n_tokens, n_known, base_score, score; stored, for the texts are read
    in the same batches for the questions and for the answers."""
    with small_batches(docs.sparkSession):
        return stored(_score(docs, model, [id_column, *carry], text_column, chunk_bytes, stretch), "lm-scores", tidy=True)


def _score(docs: DataFrame, model: Model, columns: list[str], text_column: str, chunk_bytes: int, stretch: int) -> DataFrame:
    kept = {f"__{i}": c for i, c in enumerate(columns)}
    source = docs.select(*[F.col(c).alias(k) for k, c in kept.items()], F.col(text_column).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model.arcs)
    bits = _bits(model.n_nodes)
    total, types = model.total, model.types
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in kept)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        return enumerate(pieces(batches, "__text", chunk_bytes), TaskContext.get().partitionId() << 31)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, piece in chunks(batches):
            keys = _questions(piece, sent.value)
            part = (keys >> U64(64 - bits)).astype(np.int64)
            cuts = _starts(part)
            arrays = np.split(keys, cuts[1:])
            yield pa.record_batch(
                [pa.array(np.full(len(cuts), chunk)), pa.array(part[cuts]), pa.array([len(k) for k in arrays], pa.int64()),
                 pa.array(map(_packed_keys, arrays), pa.binary())], ["chunk", "part", "n", "keys"]
            )

    def answer(nodes: pa.Table, questions: pa.Table) -> pa.Table:
        known = nodes.column("key").to_numpy().astype(np.int64).view(U64)
        order = np.argsort(known)
        known = np.append(known[order], ~U64(0))
        values = [np.append(nodes.column(c).to_numpy().astype(np.int64)[order], 0) for c in ("c", "sure")]
        found = []
        for raw, n in zip(questions.column("keys").to_pylist(), questions.column("n").to_pylist()):
            keys = _unpacked_keys(raw, n)
            at = np.searchsorted(known[:-1], keys)
            at = np.where(known[at] == keys, at, len(known) - 1)
            found.append([_packed(v[at]) for v in values])
        columns = [pa.array(c, pa.binary()) for c in zip(*found)] if found else [pa.array([], pa.binary())] * 2
        return pa.table(
            [questions.column(c) for c in ("chunk", "part", "n")] + columns,
            ["chunk", "part", "n", "c", "sure"],
        )

    def put_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, piece in chunks(batches):
            yield pa.record_batch([pa.array(np.full(piece.num_rows, chunk)), *piece.columns], ["chunk", *piece.schema.names])

    def traverse(texts: pa.Table, answers: pa.Table) -> pa.Table:
        batch = texts.combine_chunks().to_batches()[0]
        answers = answers.sort_by("part")
        counts, sure = (
            np.concatenate([_unpacked(d, n) for d, n in zip(answers.column(c).to_pylist(), answers.column("n").to_pylist())])
            for c in ("c", "sure")
        )
        automaton = Automaton(_questions(batch, sent.value), counts, sure, total, types)
        sums = []
        for piece in pieces([batch], "__text"):
            rows, count, root, cost = automaton.token_costs(Words(piece.column("__text")), stretch)
            n = piece.num_rows
            tokens, known = (np.bincount(r, minlength=n) for r in (rows, rows[count > 0]))
            sums.append([tokens, known, segment_sum(root, rows, n), segment_sum(cost, rows, n)])
        sums = [np.concatenate(x) for x in zip(*sums)]
        return pa.table(
            [*[texts.column(k) for k in kept], *[pa.array(x) for x in sums]], [*kept, "n_tokens", "n_known", "base_score", "score"]
        )

    questions = source.mapInArrow(ask, "chunk long, part long, n long, keys binary")
    nodes = model.nodes.withColumn("part", F.shiftrightunsigned("key", 64 - bits))
    answers = nodes.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(
        answer, "chunk long, part long, n long, c binary, sure binary"
    )
    answers = stored(answers, "lm-answers", tidy=True)
    texts = source.mapInArrow(put_chunk, f"chunk long, {kinds}, __text string")
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        traverse, f"{kinds}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumnsRenamed(kept)
