"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as linked classes.

A document's set holds the distinct shingles of ``size`` words (all its words as one if it has
fewer). Two documents link when 100 * |A and B| >= ``percent`` * |A or B|; the result names, for each
document, the smallest id that links reach.

Method: T-occurrence search by DivideSkip. A partner shares at least T = ceil(percent / 100 * n) of
a set's n shingles, so if the T - 1 longest inverted lists are set aside, it still occurs in one of
the others. Here all sets have one order of shingles, those of long lists last (``_frequent``), then
by hash; the first n - T + 1 + E shingles (E: the extension) are the short lists of a set, its probe
lists. Spark's shuffle on the shingle merges them. By the same count, the first shingle that partners
share leaves enough of both sets for the overlap, and they share at least 1 + E probe lists (E of the
smaller set), or the whole overlap if that is less; other candidates go. All shingles of what remains,
those of the long lists too, are then binary-probed in the partner's sorted array, and pairs that
reach the required overlap are links.

Groups of copies: documents with equal sets are one class from the start (a digest and the smallest
id), and a list does not emit all its pairs. First each list compares its members with its smallest
one; what links is one component. Then only pairs across components of a list are left: short lists
give all of them, long lists let further members (16, 256, …) meet all members of other
components, until no list has two components whose members have not met. So a group of g near
copies costs about g comparisons, and no link between different components is lost. Members meet
under the bound of their sketches: 256 parities of a set's shingles differ in at most as many places
as the sets differ in shingles, so a pair whose sketches are farther apart than links allow is no link.

Scale: the text is read for the sizes, the frequent shingles, the keys, the entries and, in each round, the sets of pairs that
share enough lists; it is never shuffled. Shuffled are one key for each probe list entry, the few
entries whose list has a second document, and the sets of those pairs. Bit maps of the repeated keys
and of the ids that need a set, sized by their count and at most 128 MB, are broadcast to drop the
other entries and rows as they are read; exact joins follow, so a full map costs time, not results.

Defined cases: null or empty texts and texts without words have an empty set, n_shingles 0, and are
their own component, as are rows without a partner; rows that share an id must be copies of each
other (the first set counts); rows with a null id come back as their own, null component. An empty
table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import forget, small_batches, stored
from ethospark.llm.components import components
from ethospark.llm.text import Words, as_long, fold, mix, pieces

SIZE, PERCENT = 4, 85
LONG = 16  # documents that make an inverted list a long one
PIVOTS = 16  # members that meet their whole long list in a round; sixteen times as many in the next
OFTEN = 16  # reported occurrences that make the shingles of a cell frequent
CELLS = range(1 << 22)
CELL = np.uint64(len(CELLS) - 1)
SKETCH = ["s0", "s1", "s2", "s3"]  # words of the sketch of a set, 64 parities each
MAP_BITS = (20, 30)  # least and greatest size of the bit map, as a power of two


def shingle_sets(words: Words, size: int):
    """(hashes, row bounds): ascending distinct shingles of every row of a slice."""
    grams, first = words.grams(size)
    rows = words.doc[first]
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):  # the whole sequence as one
        whole = [fold([words.hash[k : k + 1] for k in range(words.bounds[r], words.bounds[r + 1])])[0] for r in short]
        grams, rows = np.append(grams, np.array(whole, np.uint64)), np.append(rows, short)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1]))
        grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(words.rows + 1))


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that any partner shares."""
    return -(-percent * n // 100)


def probe_lists(n: np.ndarray, percent: int) -> np.ndarray:
    """Probe lists of a set of n: those a partner must share one of, and the extension E."""
    extension = n // 20 + 2
    return np.minimum(n, n - required(n, percent) + 1 + extension)


def _entries(words: Words, size: int, percent: int, frequent: np.ndarray):
    """(row, hash, place) of every probe list entry, and the size of each row's set."""
    grams, bounds = shingle_sets(words, size)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(words.rows), n)
    grams = grams[np.lexsort((grams, frequent[grams & CELL], owner))]
    lists = probe_lists(n, percent)
    rows = np.repeat(np.arange(words.rows), lists)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lists) - lists, lists)
    return rows, grams[bounds[rows] + place], place, n


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """For each of the cells that shingles fall into, whether it holds frequent ones.

    Every task counts its cells and reports those far above the mean. What this misses only lets a
    long list come earlier in the common order of shingles; any order finds the same pairs.
    """

    def task(batches):
        counts = np.zeros(len(CELLS), np.int32)
        for piece in pieces(batches):
            np.add.at(counts, (shingle_sets(Words(piece.column("text")), size)[0] & CELL).astype(np.int64), np.int32(1))
        mean = counts.mean()
        many = np.flatnonzero(counts > mean + 6 * np.sqrt(mean) + 4)
        yield pa.record_batch([pa.array(many), pa.array(counts[many].astype(np.int64))], ["cell", "c"])

    found = docs.select("text").mapInArrow(task, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    frequent = np.zeros(len(CELLS), bool)
    frequent[found.filter(F.col("c") >= OFTEN).select("cell").toArrow().column("cell").to_numpy()] = True
    return frequent


def _summaries(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2, sketch): size, 128-bit digest and parities of every row's set."""

    def task(batches):
        for piece in pieces(batches):
            grams, bounds = shingle_sets(Words(piece.column("text")), size)
            n = np.diff(bounds)
            digests = []
            for salt in (1, 2):  # sums of mixed hashes, over 64 bits
                sums = np.append(np.uint64(0), np.cumsum(mix(grams + np.uint64(salt * 0x5851F42D4C957F2D))))
                digests.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)))
            columns = [piece.column("id"), pa.array(n), *map(as_long, digests), *map(as_long, _parities(grams, bounds))]
            yield pa.record_batch(columns, ["id", "n", "d1", "d2", *SKETCH])

    words = ", ".join(f"{s} long" for s in SKETCH)
    return docs.mapInArrow(task, f"id {_kind(docs)}, n long, d1 long, d2 long, {words}")


def _parities(grams: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The words of each set's sketch: a bit tells whether an odd number of its shingles fall into it."""
    mixed, words = mix(grams), []
    for k in range(len(SKETCH)):
        here = np.flatnonzero(mixed >> np.uint64(62) == k)
        sums = np.append(np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (mixed[here] & np.uint64(63))))
        at = np.searchsorted(here, bounds)
        words.append(sums[at[1:]] ^ sums[at[:-1]])
    return words


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def _repeated_keys(docs: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """Keys of probe lists with two or more entries, copies included."""

    def task(batches):
        for piece in pieces(batches):
            yield pa.record_batch([as_long(_entries(Words(piece.column("text")), size, percent, frequent.value)[1])], ["key"])

    counted = docs.select("text").mapInArrow(task, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    return counted.filter("c > 1").select("key")


def _bit_map(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of the keys, 32 for each if the bounds allow; gathered as at most 2**24 words of 64 bits."""
    bits = min(MAP_BITS[1], max(MAP_BITS[0], (32 * n).bit_length()))
    cell = F.shiftrightunsigned("key", 64 - bits)
    words = keys.select(F.shiftright(cell, 6).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, %d) & 63 as int))" % (64 - bits)).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    array = np.zeros(1 << (bits - 6), np.int64)
    array[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return array.view(np.uint64)


def _lists(docs: DataFrame, repeated: DataFrame, representatives: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """(key, id, n, place): entries of lists with two or more classes."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(repeated, repeated.count()))

    def task(batches):
        array = sent.value
        shift = np.uint64(64 - (len(array).bit_length() + 5))
        for piece in pieces(batches):
            rows, keys, place, n = _entries(Words(piece.column("text")), size, percent, frequent.value)
            cell = keys >> shift
            there = np.flatnonzero((array[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1))
            rows, keys, place = rows[there], keys[there], place[there]
            yield pa.record_batch(
                [as_long(keys), piece.column("id").take(pa.array(rows)), pa.array(n[rows].astype(np.int32)), pa.array(place.astype(np.int32))],
                ["key", "id", "n", "place"],
            )

    entries = docs.mapInArrow(task, f"key long, id {_kind(docs)}, n int, place int")
    return entries.join(representatives.select("id"), "id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the ascending set of each id as binary; other rows are dropped as they are read."""
    marks = ids.select(F.xxhash64("id").alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(marks, marks.count()))

    def task(batches):
        array = sent.value
        shift = np.uint64(64 - (len(array).bit_length() + 5))
        for batch in batches:
            cell = batch.column("mark").to_numpy().view(np.uint64) >> shift
            there = (array[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1)
            for piece in pieces([batch.filter(pa.array(there.astype(bool)))]):
                grams, bounds = shingle_sets(Words(piece.column("text")), size)
                data = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.record_batch([piece.column("id"), pa.array(data, pa.binary())], ["id", "shingles"])

    marked = docs.select("id", "text", F.xxhash64("id").alias("mark"))
    return marked.mapInArrow(task, f"id {_kind(docs)}, shingles binary").join(ids, "id", "left_semi").dropDuplicates(["id"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets overlap enough: a's shingles are probed in b's sorted array."""

    def task(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x) if len(y) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return joined.mapInArrow(task, f"a {kind}, b {kind}")


def _overlap(both, percent: int):
    """Shared shingles that two sets of together ``both`` shingles need."""
    return F.ceil(F.lit(percent) * both / (100 + percent))


def _possible(percent: int):
    """Places of the first shingle two sets share that leave enough for the overlap (na, nb, pa, pb).
    Partners pass at least at that shingle; others need not."""
    return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _overlap(F.col("na") + F.col("nb"), percent)


def _near(percent: int):
    """Sketches no farther apart than partners' sets (a and b with their sizes and sketches)."""
    apart = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in SKETCH), F.lit(0))
    both = F.col("na") + F.col("nb")
    return apart <= both - 2 * _overlap(both, percent)


def link_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(summaries, classes) of ``docs`` (id, text): (id, n, d1, d2, sketch) of every row, and (id, component)
    of every representative that has a link."""
    with small_batches(docs.sparkSession):  # texts and sets are long rows
        return _link_classes(docs, size, percent)


def _link_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    summaries = stored(_summaries(docs, size), "jaccard-rows")
    classes = summaries.filter("n > 0 and id is not null").groupBy("d1", "d2", "n", *SKETCH)  # equal sets have equal sketches
    representatives = stored(classes.agg(F.min("id").alias("id")).select("id", "n", *SKETCH), "jaccard-classes")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))
    repeated = stored(_repeated_keys(docs, size, percent, frequent), "jaccard-keys", tidy=True)
    entries = stored(_lists(docs, repeated, representatives, size, percent, frequent), "jaccard-entries", tidy=True)
    forget(repeated)
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n", "place")).alias("first")).filter("c > 1")
    lists = stored(
        entries.join(sizes, "key").select("key", "id", "n", "place", "c", F.col("first.id").alias("p"), F.col("first.n").alias("pn"), F.col("first.place").alias("pp")),
        "jaccard-lists", tidy=True,
    )
    forget(entries)
    keys = stored(lists.groupBy("id").agg(F.collect_list("key").alias("keys")), "jaccard-keys-of", tidy=True)

    def linked(rows: DataFrame) -> DataFrame:
        """Links among possible pairs: they share enough probe lists, then enough of their sets."""
        pairs = rows.filter(_possible(percent)).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("least"), (F.col("na") + F.col("nb")).alias("both")
        ).distinct()
        shared = F.size(F.array_intersect("ka", "kb"))
        pairs = (
            pairs.join(keys.select(F.col("id").alias("a"), F.col("keys").alias("ka")), "a")
            .join(keys.select(F.col("id").alias("b"), F.col("keys").alias("kb")), "b")
            .filter(shared >= F.least(_overlap(F.col("both"), percent), F.floor(F.col("least") / 20) + 3)).select("a", "b")
        )
        pairs = stored(pairs, "jaccard-pairs")
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
        return _linked(pairs, stored(_sets(docs, ids, size), "jaccard-sets"), percent)

    # the first shingle that partners share is among the first n - T + 1
    lists = lists.filter(F.col("n") - F.col("place") >= F.ceil(F.lit(percent) * F.col("n") / 100))
    with_first = lists.filter("id <> p").select(
        F.col("p").alias("a"), F.col("id").alias("b"), F.col("pn").alias("na"), F.col("n").alias("nb"), F.col("pp").alias("pa"), F.col("place").alias("pb")
    )
    links = stored(linked(with_first), "jaccard-links")
    found = components(links)

    left = stored(lists.filter("id <> p").select("key", "id", "n", "place", "c"), "jaccard-left")
    pivots = PIVOTS
    while True:
        labelled = left.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", "lo")
        rows = stored(labelled.join(mixed, "key").join(representatives.drop("n"), "id"), "jaccard-mixed")
        if rows.isEmpty():
            return summaries, found
        short = rows.filter(F.col("c") <= LONG)
        ranked = _chosen(rows.filter((F.col("c") > LONG) & (F.col("component") != F.col("lo"))), pivots)
        one = short.unionByName(ranked).select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ca"), F.col("c").alias("ac"), *(F.col(s).alias(f"a{s}") for s in SKETCH))
        two = rows.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"), *(F.col(s).alias(f"b{s}") for s in SKETCH))
        pairs = one.join(two, "key").filter(_near(percent) & (F.col("ca") != F.col("cb")) & ((F.col("a") < F.col("b")) | (F.col("ac") > LONG)))
        links = stored(links.unionByName(linked(pairs)), "jaccard-links")
        found = components(links)
        left = stored(rows.filter(F.col("c") > LONG).join(ranked.select("key", "id"), ["key", "id"], "left_anti").select("key", "id", "n", "place", "c"), "jaccard-left")
        pivots *= 16


def _chosen(rows: DataFrame, pivots: int) -> DataFrame:
    """At most ``pivots`` rows of each key, those of the smallest ids."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return rows.withColumn("__r", place).filter(F.col("__r") <= pivots).drop("__r")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: the id, n_shingles, component_id, class_id (smallest id with the same set)."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    summaries, found = link_classes(rows, size, percent)
    classes = summaries.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("class"))
    linked = classes.join(found.withColumnRenamed("id", "class"), "class", "left")
    joined = summaries.join(linked, ["d1", "d2", "n"], "left")
    return joined.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.coalesce("component", "class", "id").alias("component_id"), F.coalesce("class", "id").alias("class_id"),
    )
