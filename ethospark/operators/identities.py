"""Track → identity in pieces: the lowest free identity, without a walk over a whole video.

Whether a new track gets identity j depends on j and on the tracks that no lower identity took, on nothing else. So
identities are handed out one after the other, and each as tokens: identity j has one token, and
every later stretch of an interrupted track that holds j releases one more. A token serves a chain: the first
open track, then the first open one that starts after that track's (first) stretch has ended, and so on.

A chain crosses a cut between pieces as a single number, the frame until which the token is held, and only
few numbers are possible there: the ends of tracks that reach over the cut, or a free token. Each piece
therefore answers for each of them how its chain leaves the piece; a pass over these few rows per cut
tells which entries are real; then all pieces follow their chains at the same time. A token costs two passes
over the open tracks, and there are about as many tokens as tracks alive at the same time. Pieces come to a
task as one ordered stream of rows, so that many small pieces cost little more than their rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.operators.frames import piece_of
from ethospark.session import scratch_folder

FREE = -1  # the frame until which a free token is held, relative to any piece it enters
NOBODY = -1  # the identity of an open track
BATCH = 10_000  # rows that a task hands back at once


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(batch[c].tolist() for c in batch.columns)) for batch in batches)


def _batches(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while some := list(islice(rows, BATCH)):
        yield pd.DataFrame(some, columns=columns)


def _dealt(tracks: DataFrame, entries: DataFrame) -> DataFrame:
    """The tracks of each piece and the entries (unit, cell, held, identity) to it, as one ordered stream."""
    kind = tracks.schema["track_id"].dataType
    entering = entries.select(
        "unit", "cell", F.lit(0).cast(kind).alias("track_id"), F.col("held").alias("start"),
        F.lit(0).cast("long").alias("instance"), F.col("held").alias("end"), "identity",
    )
    both = tracks.select(*[c for c in entering.columns if c != "identity"], F.lit(NOBODY).cast("long").alias("identity"))
    dealt = both.unionByName(entering).repartition("unit", "cell")
    return dealt.sortWithinPartitions("unit", "cell", "start", "instance")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(unit, cell, tracks, entries) of ``_dealt``; tracks are (track_id, start, instance, end)."""
    for (unit, cell), rows in groupby(_rows(batches), itemgetter(0, 1)):
        rows = list(rows)
        tracks = [row[2:6] for row in rows if row[6] == NOBODY]
        yield unit, cell, tracks, [(row[3], row[6]) for row in rows if row[6] != NOBODY]


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every frame that a token may be held until: the frame it is held until after this piece."""

    def answers() -> Iterator[tuple]:
        for unit, cell, tracks, entries in _pieces(batches):
            if not tracks:
                continue
            starts, ends = [t[1] for t in tracks], [t[3] for t in tracks]
            leaves = [0] * len(starts)
            for i in range(len(starts) - 1, -1, -1):
                following = bisect_right(starts, ends[i])
                leaves[i] = ends[i] if following == len(starts) else leaves[following]
            for held in sorted({FREE, *(h for h, _ in entries)}):
                i = bisect_right(starts, held)
                yield unit, cell, held, leaves[i] if i < len(starts) else held

    yield from _batches(answers(), ["unit", "cell", "held", "leaves"])


def _walk(batches: Iterator[pd.DataFrame], piece: int) -> Iterator[pd.DataFrame]:
    """From cut to cut of a unit, the entry that is real in each piece."""

    def real() -> Iterator[tuple]:
        for (unit, held, identity), of_unit in groupby(_rows(batches), itemgetter(0, 4, 5)):
            for cell, answers in groupby(of_unit, itemgetter(1)):
                if held >= (cell + 1) * piece - 1:  # held over the whole piece
                    continue
                entry = held if held >= cell * piece else FREE
                yield unit, cell, entry, identity
                held = next(row[3] for row in answers if row[2] == entry)

    yield from _batches(real(), ["unit", "cell", "held", "identity"])


def _served(tracks: list[tuple], entries: list[int]) -> list[bool]:
    """For each track, whether it is of the chain from the piece's entry, if a token enters it."""
    starts = [t[1] for t in tracks]
    served = [False] * len(starts)
    if entries:
        i = bisect_right(starts, entries[0])
        while i < len(starts):
            served[i] = True
            i = bisect_right(starts, tracks[i][3])
    return served


def _marked(batches: Iterator[pd.DataFrame], follow: Callable) -> Iterator[pd.DataFrame]:
    """The tracks, with the identity of the token that serves them, if one does."""

    def tracks_of() -> Iterator[tuple]:
        for unit, cell, tracks, entries in _pieces(batches):
            served = follow(tracks, [held for held, _ in entries])
            for track, taken in zip(tracks, served):
                yield unit, cell, *track, entries[0][1] if taken else NOBODY

    yield from _batches(tracks_of(), ["unit", "cell", "track_id", "start", "instance", "end", "identity"])


def hand_out(tracks: DataFrame, later: DataFrame, piece: int) -> DataFrame:
    """(unit, track_id, identity) of ``tracks`` (unit, track_id, start, instance, end of the first stretch).

    ``later`` has the ends of the other stretches (unit, track_id, end). Units are independent of each other. The
    driver starts a few jobs per token and receives one number each; rows stay in tables.
    """
    kind = tracks.schema["track_id"].dataType.simpleString()
    schema = f"unit string, cell long, track_id {kind}, start long, instance long, end long, identity long"
    numbers = [F.col(c).cast("long").alias(c) for c in ("start", "instance", "end")]
    open_ = _written(tracks.select("unit", "track_id", *numbers, piece_of("start", piece).alias("cell")), "open-tracks")
    free = F.lit(FREE).cast("long").alias("since")
    tokens = _written(open_.select("unit", F.lit(0).cast("long").alias("identity"), free).distinct(), "tokens")
    # tokens released by later stretches, not yet served from; equal ones are counted
    waiting = tokens.select("unit", "since", F.lit(0).cast("long").alias("n")).limit(0)
    handed = []
    while not tokens.isEmpty():
        # a token held over several cuts enters where it is released
        over = open_.filter(piece_of("end", piece) > F.col("cell")).select("unit", F.col("end").alias("held"))
        entries = over.unionByName(tokens.filter("since >= 0").select("unit", F.col("since").alias("held")))
        entries = entries.select("unit", piece_of("held", piece).alias("cell"), "held", F.lit(0).cast("long").alias("identity"))
        answers = _dealt(open_, entries).mapInPandas(_exits, "unit string, cell long, held long, leaves long")
        answers = answers.join(F.broadcast(tokens), "unit").select("unit", "cell", "held", "leaves", "since", "identity")
        real = answers.repartition("unit").sortWithinPartitions("unit", "cell").mapInPandas(
            partial(_walk, piece=piece), "unit string, cell long, held long, identity long"
        )
        marked = _written(_dealt(open_, real).mapInPandas(partial(_marked, follow=_served), schema), "served-tracks")
        handed.append(marked.filter(F.col("identity") != NOBODY).select("unit", "track_id", "identity"))
        open_ = marked.filter(F.col("identity") == NOBODY).drop("identity")
        # what the served tracks release later joins the waiting tokens; a token that no open track can use goes
        born = later.join(handed[-1], ["unit", "track_id"], "left_semi")
        born = born.select("unit", F.col("end").cast("long").alias("since"), F.lit(1).cast("long").alias("n"))
        last = open_.groupBy("unit").agg(F.max("start").alias("last"))
        usable = waiting.unionByName(born).join(F.broadcast(last), "unit").filter(F.col("since") < F.col("last"))
        waiting = _written(usable.groupBy("unit", "since").agg(F.sum("n").alias("n")), "waiting-tokens")
        first = waiting.groupBy("unit").agg(F.min("since").alias("first"))
        following = last.join(F.broadcast(first), "unit", "left").join(F.broadcast(tokens.select("unit", "identity")), "unit")
        tokens = _written(following.select(
            "unit", (F.col("identity") + F.when(F.col("first").isNull(), 1).otherwise(0)).alias("identity"),
            F.coalesce("first", F.lit(FREE).cast("long")).alias("since"),
        ), "tokens")
        waiting = _one_less(waiting, tokens)
    return reduce(DataFrame.unionByName, handed) if handed else tracks.select("unit", "track_id", F.lit(0).alias("identity"))


def _one_less(waiting: DataFrame, tokens: DataFrame) -> DataFrame:
    """``waiting`` without the token of each unit that serves now."""
    now = F.broadcast(tokens.select("unit", F.col("since").alias("now")))
    left = F.col("n") - F.when(F.col("since") == F.col("now"), 1).otherwise(0)
    return waiting.join(now, "unit").select("unit", "since", left.alias("n")).filter("n > 0")
