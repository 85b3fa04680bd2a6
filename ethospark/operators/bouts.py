"""Behaviour bouts: run-length form of class vectors and prediction clean-up.

A bout table has the key columns plus ``start``, ``end`` (inclusive), ``duration`` and
``state``; ``prev_state``/``next_state`` hold the touching neighbours' states. All stages stay
in bout form (one row per run, not per frame) and only the last step goes back to frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.operators.frames import (
    frames_of,
    position_in_key,
    running_before,
    runs,
    runs_of_intervals,
)
from ethospark.session import ensure_checkpoint_dir

NONE, NOT_BEHAVIOR, BEHAVIOR = -1, 0, 1


def encode(states: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Class vector (one row per frame) → bout table."""
    return runs(states.withColumnRenamed(state, "state"), keys)


def decode(bouts: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Bout table → one row per frame."""
    last = F.col("end") if "end" in bouts.columns else F.col("start") + F.col("duration") - 1
    return frames_of(bouts.select(*keys, "start", last.alias("end"), state)).select(
        *keys, "frame", state
    )


def numbered(bouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the 0-based index of each bout within its sequence."""
    return position_in_key(bouts, keys, "start", "bout_id")


def violations(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a hand-made event table that break the run-length rules.

    Rules: starts ascend, no gap or overlap between neighbours, neighbours differ in state,
    durations are positive. Neighbours are found through ``bout_id`` so the check is one
    equi-join on (keys, bout_id), independent of how long a sequence is.
    """
    last = F.col("start") + F.col("duration")
    before = events.select(
        *keys, (F.col("bout_id") + 1).alias("bout_id"), F.col("start").alias("_start"),
        last.alias("_stop"), F.col("state").alias("_state"),
    )
    checked = events.join(before, [*keys, "bout_id"], "left")
    problem = (
        F.when(F.col("duration") <= 0, "empty")
        .when(F.col("start") <= F.col("_start"), "not ascending")
        .when(F.col("start") != F.col("_stop"), "gap or overlap")
        .when(F.col("state") == F.col("_state"), "repeated state")
    )
    return (
        checked.withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select(*keys, "bout_id", "start", "duration", "state", "problem")
    )


def delete(bouts: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Delete flagged bouts; their frames go to the touching neighbours.

    The first bout is absorbed by the next one, the last by the previous one. Between equal
    neighbours the three become one bout; between different ones the previous neighbour takes
    floor(d/2) frames and the next one the rest. A sole bout stays.

    Each bout's new owner depends on its two neighbours only, which ``encode`` has already put
    on the row. Two flagged bouts must not touch (stages flag a single state, so theirs never
    do); touching ones raise, see ``delete_touching``.
    """
    rows = runs_of_intervals(bouts.withColumn("_gone", flag), keys, ("state", "_gone"))
    checked = rows.withColumn(
        "_gone",
        F.expr("""CASE WHEN _gone AND (coalesce(prev__gone, FALSE) OR coalesce(next__gone, FALSE))
            THEN CAST(raise_error('touching bouts cannot be deleted together') AS BOOLEAN)
            ELSE _gone END"""),
    )
    return runs_of_intervals(_pieces(checked, keys, "_gone"), keys)


def delete_touching(bouts: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """``delete`` for flagged bouts that may touch each other; they go from last to first.

    Single flagged bouts take the closed form first: they never change what a stretch of touching
    ones does. In a stretch every deletion may use up one kept bout to its right. Matching each
    flagged bout with a kept one to its right, like brackets, therefore tells how far a stretch can
    reach; such groups are cut out (with the bout before them) and settled one bout after the other
    in a task of their own. A group grows with its stretches, not with the sequence.
    """
    keys = list(keys)
    flagged = bouts.withColumn("_gone", flag)
    rows = runs_of_intervals(flagged, keys, ("state", "_gone"))
    touches = "coalesce(prev__gone, FALSE) OR coalesce(next__gone, FALSE)"
    parts = rows.selectExpr("*", f"_gone AND ({touches}) AS _stretch")
    single = _pieces(parts, keys, "_gone AND NOT _stretch", ["_stretch"])
    # pieces of equal state merge again; a stretch bout keeps its mark and stays apart
    left = runs_of_intervals(single, keys, ("state", "_stretch")).select(
        *keys, "start", "end", "state", "_stretch"
    )
    ensure_checkpoint_dir(bouts.sparkSession)
    left = left.checkpoint()  # both tables are read several times
    ranked = position_in_key(left, keys, "start", "_i").checkpoint()
    depth = running_before(ranked, keys, "_i", "IF(_stretch, 1, -1)", "sum", "_depth")
    depth = depth.selectExpr("*", "coalesce(_depth, 0) + IF(_stretch, 1, -1) AS _sum")
    lowest = running_before(depth, keys, "_i", "_sum", "min", "_lowest")
    # an unmatched kept bout takes the sum to a new low
    matched = lowest.filter("_stretch OR _sum >= least(0, _lowest)")
    groups = runs(matched, keys, [], "_i").selectExpr(
        *[f"`{k}`" for k in keys], "greatest(start - 1, 0) AS start", "end", "start AS _group"
    )
    grouped = ranked.join(frames_of(groups, name="_i"), [*keys, "_i"], "left")
    schema = left.drop("_stretch").schema
    names = [*keys, "_group", "start", "end", "state", "_stretch"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, waiting = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch[n].tolist() for n in names)):
                if row[:-4] != unit:
                    out += [(*unit[:-1], *bout) for bout in _settled(waiting)] if unit else []
                    unit, waiting = row[:-4], []
                waiting.append(list(row[-4:]))
            yield pd.DataFrame(out, columns=schema.names)
        if unit:
            last = [(*unit[:-1], *bout) for bout in _settled(waiting)]
            yield pd.DataFrame(last, columns=schema.names)

    ordered = grouped.filter("_group IS NOT NULL").select(*names)
    ordered = ordered.repartition(*keys, "_group").sortWithinPartitions(*keys, "_group", "start")
    settled = ordered.mapInPandas(stream, schema)
    rest = grouped.filter("_group IS NULL").select(*schema.names)
    return runs_of_intervals(rest.unionByName(settled), keys)


def _settled(waiting: list[list]) -> list[tuple]:
    """Delete the marked bouts of one group, last to first; bouts are [start, end, state, marked]."""
    done: list[list] = []  # nearest bout last
    while waiting:
        bout = waiting.pop()
        before = waiting[-1] if waiting else None
        after = done[-1] if done else None
        if not bout[3] or (before is None and after is None):
            done.append(bout)
        elif before is None:
            after[0] = bout[0]
        elif after is None:
            before[1] = bout[1]
        elif before[2] == after[2]:
            before[1] = done.pop()[1]
        else:
            before[1] += (bout[1] - bout[0] + 1) // 2
            after[0] = before[1] + 1
    return [tuple(bout[:3]) for bout in done]


def _pieces(bouts: DataFrame, keys: Sequence[str], flag: str, carry: Sequence[str] = ()) -> DataFrame:
    """Bouts, with each flagged one under its neighbours' states; not merged yet."""
    part = "named_struct('start', {}, 'end', {}, 'state', {})".format
    middle = "start + CAST(floor(duration / 2) AS INT)"
    kept = part("start", "end", "state")
    whole = part("start", "end", "coalesce(prev_state, next_state, state)")
    halves = f"{part('start', f'{middle} - 1', 'prev_state')}, {part(middle, 'end', 'next_state')}"
    names = [f"`{k}`" for k in [*keys, *carry]]
    pieces = bouts.selectExpr(
        *names,
        f"""explode(CASE WHEN NOT ({flag}) THEN array({kept})
            WHEN prev_state <> next_state THEN array({halves}) ELSE array({whole}) END) AS p""",
    )
    return pieces.selectExpr(*names, "p.*").filter("start <= end")


# --- clean-up stages -------------------------------------------------------------------

class Stage(NamedTuple):
    """Bouts under the SQL condition ``flag`` give their frames to their neighbours.

    Those under ``alone`` have no neighbours and become NOT_BEHAVIOR.
    """

    flag: str
    alone: str = "FALSE"

    def __call__(self, bouts: DataFrame, keys: Sequence[str]) -> DataFrame:
        if self.alone != "FALSE":
            bouts = bouts.withColumn("state", F.expr(f"CASE WHEN {self.alone} THEN {NOT_BEHAVIOR} ELSE state END"))
        return runs_of_intervals(_pieces(bouts, keys, self.flag), keys)


def _positive(name: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def interpolate_gaps(max_interpolation_gap: int) -> Stage:
    """Fill stretches without a prediction of at most this many frames."""
    limit = _positive("max_interpolation_gap", max_interpolation_gap)
    return Stage(f"state = {NONE} AND duration <= {limit}")


def stitch(max_stitch_gap: int) -> Stage:
    """Join bouts separated by at most this many NOT_BEHAVIOR frames."""
    limit = _positive("max_stitch_gap", max_stitch_gap)
    return Stage(f"state = {NOT_BEHAVIOR} AND duration <= {limit}")


def drop_short(min_duration: int) -> Stage:
    """Remove BEHAVIOR bouts shorter than this; a lone short bout becomes NOT_BEHAVIOR."""
    limit = _positive("min_duration", min_duration)
    short = f"state = {BEHAVIOR} AND duration < {limit}"
    return Stage(short, f"{short} AND prev_state IS NULL AND next_state IS NULL")


# Stage names as they appear in configuration files (fixed values).
STAGES: dict[str, Callable[..., Stage]] = {
    "GapInterpolationStage": interpolate_gaps,
    "BoutStitchingStage": stitch,
    "BoutDurationFilterStage": drop_short,
}


def build_stages(config: Sequence[Mapping[str, Any]]) -> list[Stage]:
    """Validate a stage list and return the enabled stages in order."""
    stages = []
    for position, entry in enumerate(config):
        extra = set(entry) - {"stage_name", "parameters", "enabled"}
        parameters = entry.get("parameters")
        if extra or "stage_name" not in entry or "parameters" not in entry:
            raise ValueError(f"stage {position}: needs stage_name and parameters, got {sorted(entry)}")
        if not isinstance(entry["stage_name"], str) or not isinstance(entry.get("enabled", True), bool):
            raise ValueError(f"stage {position}: wrong type of stage_name or enabled")
        if parameters is not None and not isinstance(parameters, Mapping):
            raise ValueError(f"stage {position}: parameters must be a mapping or null")
        if not entry.get("enabled", True):
            continue
        if entry["stage_name"] not in STAGES:
            raise ValueError(f"stage {entry['stage_name']!r} is not recognized")
        try:
            stages.append(STAGES[entry["stage_name"]](**(parameters or {})))
        except TypeError as error:
            raise ValueError(f"stage {position}: {error}") from error
    return stages


def clean_bouts(
    bouts: DataFrame, keys: Sequence[str], config: Sequence[Mapping[str, Any]]
) -> DataFrame:
    """Run the configured stages on a bout table, in order."""
    for stage in build_stages(config):
        bouts = stage(bouts, keys)
    return bouts


def clean_predictions(
    predictions: DataFrame,
    keys: Sequence[str],
    config: Sequence[Mapping[str, Any]],
    cls: str = "cls",
) -> DataFrame:
    """Add ``cls_post`` to a per-frame prediction table; the raw class stays."""
    bouts = clean_bouts(encode(predictions, keys, cls), keys, config)
    post = decode(bouts, keys).withColumnRenamed("state", "cls_post")
    return predictions.join(post, [*keys, "frame"])


def clean_by_behavior(
    predictions: DataFrame,
    keys: Sequence[str],
    configs: Mapping[str, Sequence[Mapping[str, Any]]],
) -> DataFrame:
    """Apply each behaviour's own stages to its predictions.

    All behaviours take their first stage together, then their second, and so on: the condition of a
    stage is looked up by behaviour, so the passes do not depend on how many behaviours there are.
    Only the configured behaviours are processed. Behaviours without rows, and multi-class
    predictions (``class_names`` set), are errors.
    """
    known = predictions.filter(F.col("behavior").isin(*configs)).groupBy("behavior")
    has_names = (
        F.max(F.col("class_names").isNotNull())
        if "class_names" in predictions.columns
        else F.lit(False)
    )
    # one row per configured behaviour, so this list is as short as the configuration
    found = {r["behavior"]: r["multi"] for r in known.agg(has_names.alias("multi")).collect()}
    missing = [b for b in configs if b not in found]
    if missing:
        raise ValueError(f"behaviours without predictions: {missing}")
    multi = [b for b, names in found.items() if names]
    if multi:
        raise ValueError(f"clean-up needs binary predictions, these are multi-class: {multi}")
    stages = {b: build_stages(config) for b, config in configs.items()}
    keyed = [*[k for k in keys if k != "behavior"], "behavior"]
    chosen = predictions.filter(F.col("behavior").isin(*configs))
    bouts = encode(chosen, keyed, "cls")
    for nth in range(max(map(len, stages.values()))):
        step = {b: s[nth] for b, s in stages.items() if nth < len(s)}
        flag, alone = (_by_behavior({b: s[part] for b, s in step.items()}) for part in range(2))
        bouts = Stage(flag, alone)(bouts, keyed)
    post = decode(bouts, keyed).withColumnRenamed("state", "cls_post")
    return chosen.join(post, [*keyed, "frame"]).select(*predictions.columns, "cls_post")


def _by_behavior(conditions: Mapping[str, str]) -> str:
    """The condition of a bout's behaviour; behaviours without one have none of their bouts changed."""
    quoted = {b.replace("\\", "\\\\").replace("'", "\\'"): c for b, c in conditions.items()}
    cases = " ".join(f"WHEN '{b}' THEN {c}" for b, c in quoted.items() if c != "FALSE")
    return f"(CASE behavior {cases} ELSE FALSE END)" if cases else "FALSE"
