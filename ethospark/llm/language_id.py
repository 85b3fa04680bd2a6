"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text becomes lower-case letters (digits and symbols turn into single spaces). A model of order
``ORDER`` gives each letter a probability from the letters before it: the longest history uses
counts, shorter ones use the number of different letters that precede them, each with one absolute
discount, down to a uniform floor. The language with the lowest cross-entropy per letter wins. All
languages share one sorted array per order: an n-gram seen in any language has, for each language,
its finished probability and the weight of its history, so a text needs one look-up per letter and
order it falls back to.

Fitting: the models learn from a sample of the labelled rows' different texts, drawn by their hash, of
``TRAIN_CHARS`` characters a language (and the rest of its last text); this documented bound is what keeps
the models small enough to broadcast at any size of the corpus. Every tenth text is held back: it sets the
temperature of the score and, per language, the cross-entropy from which a text is rejected: halfway
between texts of the language and texts of the others under the same model, and higher for short
texts, by ``DEVIATIONS`` times the usual deviation over the root of the length.

Scale: the sample's n-grams are counted by Spark; predictions are one pass without a shuffle.

Defined cases: a text that is null or has no letter is ``und``, score 0, rejected; of equal
cross-entropies the language first in the alphabet wins; rows with a null label do not teach; without
labelled rows every text is ``und``. Repeated rows are predicted each; an empty table gives an empty
table. Label and id are never used for a prediction; other columns pass through, but for those that
have a name of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import stored
from ethospark.llm.hash_array import HashArray
from ethospark.llm.text import PIECE_BYTES, U64, fold, pieces, segment_sum

ORDER = 4
TRAIN_CHARS = 8_000_000  # characters of the sample for each language
SURE = 64  # expected texts of a language below its rate, at least
UNKNOWN = "und"
DISCOUNT = 0.75
ALPHABET = 2_000  # letters of the uniform floor
DEVIATIONS = 3.0  # by which a short text's cross-entropy may exceed the limit of long ones
_LETTERS = re.compile(r"[^\W\d_]+")
RESULT = ["lang_pred", "score", "cross_entropy", "rejected"]


@dataclass
class Profile:
    """Models of all languages side by side."""

    languages: list[str]
    grams: list[HashArray]  # by order, from 1
    log_p: list[np.ndarray]  # by order: (n-gram, language)
    log_weight: list[np.ndarray]  # by order of the history, from 0: (history, language)
    mean: np.ndarray | None = None  # of the languages' cross-entropies
    reach: np.ndarray | None = None  # how far above the mean a long text may lie
    deviation: np.ndarray | None = None  # of one letter
    temperature: float = 1.0

    def cross_entropy(self, texts: pa.Array):
        """(per row and language, letters of each row): natural logs, per letter."""
        columns, rows = _letters(texts, len(self.grams))
        n, size = len(texts), len(rows)
        total = np.zeros((size, len(self.languages)), np.float32)
        todo = np.arange(size)
        for order in range(len(self.grams), 0, -1):
            own = [c[todo].astype(U64) for c in columns[-order:]]
            at = self.grams[order - 1].find(fold(own))
            hit = at >= 0
            total[todo[hit]] += self.log_p[order - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order > 1:  # the history gives its left-over weight to the shorter one
                history = self.grams[order - 2].find(fold([c[~hit] for c in own[:-1]]))
                seen = history >= 0
                total[todo[seen]] += self.log_weight[order - 1][history[seen]]
            else:  # a letter no model knows
                total[todo] += self.log_weight[0][0] - np.float32(np.log(ALPHABET))
        length = np.bincount(rows, minlength=n)
        sums = np.stack([segment_sum(total[:, k], rows, n) for k in range(len(self.languages))], axis=1)
        return -sums / np.maximum(length, 1)[:, None], length


def _clean(text: str) -> str:
    """Lower-case letters, anything between them one space; a space around. '' without a letter."""
    words = _LETTERS.findall(text.lower())
    if not any(letter.isalpha() for word in words for letter in word):  # stops at the first
        return ""
    return " " + " ".join(words) + " "


def _letters(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, rows): the ``order`` letters up to each letter, oldest first, spaces before a text's
    start; and the text of each letter."""
    points, rows = [], []
    for i, text in enumerate(texts.to_pylist()):
        clean = _clean(text) if text else ""
        if clean:
            points.append(np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.int32))
            rows.append(np.full(len(points[-1]), i))
    if not points:
        return [np.zeros(0, np.int32)] * order, np.zeros(0, np.int64)
    codes, rows = np.concatenate(points), np.concatenate(rows)
    columns = [codes]
    for back in range(1, order):
        column = np.full(len(codes), 32, np.int32)
        if back < len(codes):
            column[back:] = np.where(rows[back:] == rows[:-back], codes[:-back], 32)
        columns.insert(0, column)
    return columns, rows


def fit(
    train: DataFrame, text_column: str = "text", label_column: str = "lang", order: int = ORDER, train_chars: int = TRAIN_CHARS,
) -> Profile:
    """Models and calibration from the rows of ``train`` with a label."""
    rows = train.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(label_column).alias("lang"), F.col(text_column).alias("text")
    )
    sample = _sample(rows, train_chars)
    if sample is None:
        return Profile([], [], [], [])
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    number = {k: i for i, k in enumerate(languages)}

    def grams(batches):
        for piece in pieces(batches):
            columns, rows = _letters(piece.column("text"), order)
            if len(rows):
                lang = np.array([number[x] for x in piece.column("lang").to_pylist()], np.int32)[rows]
                distinct, counts = np.unique(np.stack([lang, *columns], axis=1), axis=0, return_counts=True)
                yield pa.record_batch([*[pa.array(distinct[:, k]) for k in range(order + 1)], pa.array(counts)], ["lang", *names, "n"])

    names = [f"c{k}" for k in range(order)]
    counted = (
        sample.filter(~F.col("held")).select("lang", "text")
        .mapInArrow(grams, ", ".join(["lang int", *[f"{c} int" for c in names], "n long"]))
        .groupBy("lang", *names).agg(F.sum("n").alias("n")).toArrow()
    )
    profile = _smooth(counted, languages, order)
    _calibrate(profile, sample)
    return profile


def _sample(rows: DataFrame, train_chars: int) -> DataFrame | None:
    """(lang, text, held): different texts of every language, drawn by their hash; every tenth is held back.

    A language's texts are taken in the order of their hashes until they have ``train_chars`` characters,
    so a language goes over the bound by less than its last text, and none with a text goes without. Copies count once.
    Only those below a rate that leaves some twice the bound, or ``SURE`` texts, are ordered. Broadcast is a hash for
    each text taken, different texts of ``train_chars`` characters in all.
    """
    keyed = rows.withColumn("h", F.xxhash64("text"))
    texts = stored(keyed.groupBy("lang", "h").agg(F.max(F.char_length("text")).alias("n")).filter("n > 0"), "language-texts")
    found = texts.groupBy("lang").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("texts")).collect()
    if not found:
        return None
    rates = {r["lang"]: min(1.0, max(2 * train_chars / r["chars"], SURE / r["texts"])) for r in found}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    drawn = texts.filter(F.pmod("h", F.lit(1_000_000)) / 1_000_000.0 < rate)
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h")
    ranked = drawn.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    taken = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("before") < train_chars)
    taken = taken.select("lang", "h", (F.col("place") % 10 == 0).alias("held"))
    return stored(keyed.join(F.broadcast(taken), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", "held"), "language-sample")


def _smooth(counted: pa.Table, languages: list[str], order: int) -> Profile:
    """Interpolated Kneser-Ney from the distinct n-grams of the highest order (bounded by the sample)."""
    lang = counted.column("lang").to_numpy()
    letters = [counted.column(f"c{k}").to_numpy() for k in range(order)]
    counts = counted.column("n").to_numpy().astype(float)
    k_languages = len(languages)
    by_order = {}
    rows = np.stack([lang, *letters], axis=1)
    for size in range(order, 0, -1):  # (language, letters) and their counts or numbers of preceding letters
        by_order[size] = (rows, counts)
        rows, counts = np.unique(np.delete(rows, 1, axis=1), axis=0, return_counts=True)
        counts = counts.astype(float)
    grams, log_p, log_weight = [], [], []
    lower_p = None
    for size in range(1, order + 1):
        rows, counts = by_order[size]
        hashes = fold([rows[:, 1 + k].astype(U64) for k in range(size)])
        keys, at = np.unique(hashes, return_inverse=True)
        if size > 1:
            history = fold([rows[:, 1 + k].astype(U64) for k in range(size - 1)])
            index = grams[-1].find(history)  # every history ends at some letter, so it is there
        else:
            index = np.zeros(len(rows), int)
        n_history = len(grams[-1]) if size > 1 else 1
        total, types = np.zeros((n_history, k_languages)), np.zeros((n_history, k_languages))
        np.add.at(total, (index, rows[:, 0]), counts)
        np.add.at(types, (index, rows[:, 0]), 1)
        weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        # probability of every n-gram in every language
        own = np.zeros((len(keys), k_languages))
        own[at, rows[:, 0]] = counts
        of = np.zeros(len(keys), int)
        of[at] = index
        seen = total[of] > 0
        sure = np.where(seen, np.maximum(own - DISCOUNT, 0) / np.maximum(total[of], 1), 0)
        if size == 1:
            below = np.full((len(keys), k_languages), 1 / ALPHABET)
        else:
            suffix = fold([rows[:, 2 + k].astype(U64) for k in range(size - 1)])
            tail = np.zeros(len(keys), int)
            tail[at] = grams[-1].find(suffix)
            below = lower_p[tail]
        p = sure + weight[of] * below
        grams.append(HashArray(keys))
        log_p.append(np.log(p).astype(np.float32))
        log_weight.append(np.log(weight).astype(np.float32))
        lower_p = p
    return Profile(languages, grams, log_p, log_weight)


def _calibrate(profile: Profile, sample: DataFrame) -> None:
    """Temperature of the score, and mean and reach of each language's cross-entropy, from the texts held back."""
    sent = sample.sparkSession.sparkContext.broadcast(profile)
    names = [f"h{k}" for k in range(len(profile.languages))]

    def task(batches):
        for piece in pieces(batches):
            entropy, length = sent.value.cross_entropy(piece.column("text"))
            yield pa.record_batch([piece.column("lang"), pa.array(length), *[pa.array(entropy[:, k]) for k in range(len(names))]], ["lang", "length", *names])

    schema = ", ".join(["lang string", "length long", *[f"{x} double" for x in names]])
    held = sample.filter("held").select("lang", "text").mapInArrow(task, schema).filter("length > 0").toArrow()
    n = len(profile.languages)
    number = {k: i for i, k in enumerate(profile.languages)}
    own = np.array([number[x] for x in held.column("lang").to_pylist()], int)
    entropy = np.stack([held.column(x).to_numpy() for x in names], axis=1) if held.num_rows else np.zeros((0, n))
    length = held.column("length").to_numpy()
    far = np.log(ALPHABET)
    profile.mean, profile.reach, profile.deviation = np.full(n, far / 2), np.full(n, far / 4), np.full(n, 1.0)
    for k in range(n):
        mine = own == k
        if mine.any():
            profile.mean[k] = np.average(entropy[mine, k], weights=length[mine])
            profile.deviation[k] = max(1.0, np.median(np.abs(entropy[mine, k] - profile.mean[k]) * np.sqrt(length[mine])))
        others = np.average(entropy[~mine, k], weights=length[~mine]) if (~mine).any() else far
        profile.reach[k] = max(0.5, (others - profile.mean[k]) / 2)
    if len(own):
        loss = lambda t: -np.mean(_log_softmax(-t * entropy)[np.arange(len(own)), own])
        profile.temperature = float(min((2.0**e for e in range(-3, 7)), key=loss))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def predict(docs: DataFrame, profile: Profile, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected."""
    kept = [f for f in docs.schema.fields if f.name not in RESULT]
    sent = docs.sparkSession.sparkContext.broadcast(profile)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string", "score double", "cross_entropy double", "rejected boolean"])

    def task(batches):
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for piece in pieces(batches, text_column, 4 * PIECE_BYTES // max(4, len(model.languages))):
            n = piece.num_rows
            best, score, least, rejected = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n), np.ones(n, bool)
            if model.languages:
                entropy, length = model.cross_entropy(piece.column(text_column))
                some = np.flatnonzero(length)
                best[some] = entropy[some].argmin(axis=1)
                least[some] = entropy[some, best[some]]
                if len(some):
                    score[some] = np.exp(_log_softmax(-model.temperature * entropy[some])).max(axis=1)
                own = best[some]
                limit = model.mean[own] + model.reach[own] + DEVIATIONS * model.deviation[own] / np.sqrt(length[some])
                rejected[some] = least[some] > limit
            made = [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(least, mask=best == len(names) - 1), pa.array(rejected)]
            yield pa.record_batch([*[piece.column(f.name) for f in kept], *made], [*[f.name for f in kept], *RESULT])

    return docs.select(*[f.name for f in kept]).mapInArrow(task, schema)
