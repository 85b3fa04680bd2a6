"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at counts of a text and votes good, bad or abstains. The accuracy of each rule and
the share of good texts are estimated by expectation-maximisation from how the rules agree, without
labels: texts with the same votes count together, so EM sees at most 3**rules vote patterns with
their numbers of texts, gathered over all texts. A text is kept when its posterior probability of
being good is at least ``keep_from``. Only DataFrame functions; EM itself is arithmetic on the small
table of patterns.

Scale: one narrow pass over the texts writes the counts (a dozen numbers a row); no text is shuffled.
The aggregation by vote pattern combines before its shuffle.

Defined cases: a null text is empty, has zero counts and fails the base rules; repeated rows are
rows of their own; null ids pass through; an empty table gives an empty table. Only the id and the
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import let, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"


def _n_repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the text."""
    size = F.size(words)

    def covered(starts: Column) -> Column:
        # starts ascend: each window adds what the one before it has not covered
        added = F.transform(starts, lambda s, k: F.when(k == 0, window).otherwise(F.least(F.lit(window), s - F.get(starts, k - 1))))
        return F.aggregate(added, F.lit(0), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(pairs, k).h == e.h, F.lit(False))
        twice = F.filter(pairs, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return let(F.sort_array(F.transform(twice, lambda e: e.i)), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(1), size - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(size < window + 1, 0).otherwise(let(hashes, count))


def text_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the counts the rules look at, all long."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            _n_repeat_words(w, WINDOW).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"^[^\p{L}]*\p{L}+[^\p{L}]?$"))).alias("n_plain_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda l: l.rlike(r"""[.!?…:;"»”)]\s*$"""))).alias("n_ended_lines"),
        )

    return docs.select(
        F.col(id_column).alias(id_column),
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.char_length(F.translate(text, _SPACES, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    ).select(
        id_column,
        *[
            F.col(c).cast("long").alias(c.rpartition(".")[2])
            for c in ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_plain_words", "l.n_lines", "l.n_ended_lines")
        ],
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _rule(value: Column, good: Callable[[Column], Column], bad: Callable[[Column], Column]) -> Column:
    """1 good, -1 bad, 0 abstains; no value abstains."""
    return F.when(bad(value), -1).when(good(value), 1).otherwise(0)


def rules() -> dict[str, Column]:
    return {
        "length": _rule(F.col("n_words"), lambda v: v >= 50, lambda v: v < 20),
        "word_length": _rule(_share("word_chars", "n_words"), lambda v: v.between(3, 10), lambda v: (v < 2.5) | (v > 14)),
        "symbols": _rule(_share("n_symbols", "n_words"), lambda v: v <= 0.02, lambda v: v > 0.1),
        "dup_lines": _rule(_share("n_dup_lines", "n_lines"), lambda v: (v <= 0.05) & (F.col("n_lines") > 2), lambda v: v > 0.3),
        "repeats": _rule(_share("n_repeat_words", "n_words"), lambda v: v <= 0.05, lambda v: v > 0.2),
        "plain_words": _rule(_share("n_plain_words", "n_words"), lambda v: v >= 0.8, lambda v: v < 0.6),
        "ended_lines": _rule(_share("n_ended_lines", "n_lines"), lambda v: v >= 0.6, lambda v: v < 0.2),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, start: float = 0.8) -> tuple[float, list[float]]:
    """EM: (share of good texts, accuracy of each rule where it votes).

    Accuracies start above a half, which says which class is the good one, and stay in 0.5..0.99.
    """
    if not patterns:
        return 0.5, []
    n = len(patterns[0][0])
    prior, accuracy = 0.5, [start] * n
    for _ in range(rounds):
        good_total, right, voted = 1.0, [start * 10] * n, [10.0] * n  # ten votes of the start value smooth
        total = 2.0
        for votes, count in patterns:
            p = posterior(votes, prior, accuracy)
            total += count
            good_total += p * count
            for k, v in enumerate(votes):
                if v:
                    voted[k] += count
                    right[k] += count * (p if v > 0 else 1 - p)
        prior = min(0.99, max(0.01, good_total / total))
        now = [min(0.99, max(0.5, r / v)) for r, v in zip(right, voted)]
        done = max(abs(a - b) for a, b in zip(now, accuracy)) < 1e-9
        accuracy = now
        if done:
            break
    return prior, accuracy


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))
    return 1 / (1 + math.exp(-odds))


def score_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_from: float = 0.5,
) -> DataFrame:
    """The id, all counts, one ``vote_…`` per rule, ``quality`` (posterior), ``base_failed``, ``kept``."""
    voting = rules()
    counts = stored(text_counts(docs, id_column, text_column), "quality-counts")
    voted = counts.select("*", *[rule.cast("int").alias(f"vote_{name}") for name, rule in voting.items()])
    names = [f"vote_{name}" for name in voting]
    # at most 3**rules rows
    seen = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, accuracy = fit([(tuple(r[x] for x in names), r["n"]) for r in sorted(seen)])
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, a in zip(names, accuracy):
        odds = odds + F.col(name) * F.lit(math.log(a / (1 - a)))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    quality = 1 / (1 + F.exp(-odds))
    return voted.select(
        "*", quality.alias("quality"), failed.alias("base_failed"), (~failed & (quality >= keep_from)).alias("kept"),
    )
