"""All window features of a wide per-frame table in one pass.

``windows`` and ``spectrum`` define the operators column by column. A full table has some 240
feature columns and 4,500 window columns; as expressions that is one enormous plan. Here Spark
cuts the sequences into pieces with halo (one shuffle, no joins) and each piece is computed column
by column in numpy. Results equal the column-wise operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethospark.operators import spectrum
from ethospark.operators.frames import with_halo
from ethospark.operators.windows import (
    CIRCULAR_OPS,
    LINEAR_OPS,
    check_sizes,
    missing_to_null,
    quoted,
    window_name,
)
from ethospark.skeleton import DEFAULT_FPS

CELLS_PER_PIECE = 4_000_000  # output values of one piece, about 32 MB


def _statistics(segments: np.ndarray, ops: Sequence[str]) -> dict[str, np.ndarray]:
    """Statistics of each row of (n, 2k+1) segments, NaN skipped; NaN where undefined."""
    known = ~np.isnan(segments)
    n = known.sum(axis=1)
    total = np.where(known, segments, 0.0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total / n
        apart = np.where(known, segments - mean[:, None], 0.0)
        m2, m3, m4 = ((apart**p).sum(axis=1) / n for p in (2, 3, 4))
        spread = np.where(m2 > 0, m2, np.nan)
        out = {
            "mean": mean, "std_dev": np.sqrt(m2), "skew": m3 / spread**1.5, "kurtosis": m4 / spread**2
        }
    if "median" in ops:
        ordered = np.sort(segments, axis=1)  # NaN last
        at = lambda i: np.take_along_axis(ordered, np.maximum(i, 0)[:, None], axis=1)[:, 0]
        out["median"] = (at((n - 1) // 2) + at(n // 2)) / 2
    empty = n == 0
    out["max"] = np.where(empty, np.nan, np.where(known, segments, -np.inf).max(axis=1))
    out["min"] = np.where(empty, np.nan, np.where(known, segments, np.inf).min(axis=1))
    return {op: np.where(empty, np.nan, out[op]) for op in ops}


def _circular(segments: np.ndarray, low: float, ops: Sequence[str]) -> dict[str, np.ndarray]:
    known = ~np.isnan(segments)
    n = known.sum(axis=1)
    turn = np.radians(np.where(known, segments, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(known, np.sin(turn), 0.0).sum(axis=1) / n
        c = np.where(known, np.cos(turn), 0.0).sum(axis=1) / n
        degrees = np.degrees(np.arctan2(s, c))
        length = np.minimum(1.0, np.sqrt(s * s + c * c))
        out = {
            "mean": degrees - 360 * np.floor((degrees - low) / 360),
            "std_dev": np.degrees(np.sqrt(-2 * np.log(length))),
        }
    return {op: out[op] for op in ops}


def window_matrix(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    linear_columns: Sequence[str] = (),
    circular_columns: Mapping[str, float] | None = None,
    present: str = "present",
    ops: Sequence[str] = tuple(LINEAR_OPS),
    spectral_ops: Sequence[str] = tuple(spectrum.SUMMARY_OPS),
    fps: float | str = DEFAULT_FPS,
    frame: str = "frame",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Keys, frame and every window column of window size ``k``.

    ``carry`` names per-frame columns to keep next to them, which saves a join.

    ``circular_columns`` maps a column to the low end of its range (-180 or 0); they use only frames
    with ``present`` and are NULL on frames without. Linear columns get ``ops`` and
    ``spectral_ops``. ``fps`` is one number or the column that has each video's.
    """
    (k,) = check_sizes([k])
    keys, linear_columns = list(keys), list(linear_columns)
    circular_columns = dict(circular_columns or {})
    inputs = [*linear_columns, *circular_columns]
    marks = [present] if circular_columns and present not in carry else []
    needed = list(dict.fromkeys([*carry, *inputs]))
    own_rates = isinstance(fps, str)
    rates = [F.col(fps).cast("double").alias("_fps")] if own_rates else []
    rows = missing_to_null(df.select(*keys, frame, *marks, *rates, *map(quoted, needed)), inputs)
    names = [window_name(c, op) for c in linear_columns for op in [*ops, *spectral_ops]]
    names += [window_name(c, op) for c in circular_columns for op in CIRCULAR_OPS]
    kept = [*keys, frame, *carry]
    fields = [rows.schema[c] for c in kept]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names])
    piece = max(256, CELLS_PER_PIECE // max(1, len(names)))
    unit = [*keys, "_piece"]

    def compute(pdf: pd.DataFrame) -> pd.DataFrame:
        """All columns of some whole pieces: they are laid out one after the other, k gaps apart."""
        at = pdf[frame].to_numpy()
        begins = _changes(pdf, unit)
        starts = np.flatnonzero(begins)
        lengths = at[np.append(starts[1:], len(at)) - 1] - at[starts] + 1
        offsets = np.concatenate([[0], np.cumsum(lengths + k)[:-1]])
        position = at - np.repeat(at[starts] - offsets, np.diff(np.append(starts, len(at))))
        size = int(position[-1]) + 1
        own = at // piece == pdf["_piece"].to_numpy()
        where = position[own]

        def dense(values: np.ndarray) -> np.ndarray:
            out = np.full(size, np.nan)
            out[position] = values
            return out

        def segments(values: np.ndarray) -> np.ndarray:
            padded = np.pad(values, k, constant_values=np.nan)
            return np.lib.stride_tricks.sliding_window_view(padded, 2 * k + 1)[where]

        row_rates = pdf["_fps"].to_numpy(dtype=float)[own] if own_rates else np.full(len(where), float(fps))

        def spectral(amplitude: np.ndarray) -> dict[str, np.ndarray]:
            """Summaries of amplitudes at one frame per second, each row at its video's rate."""
            found = {op: np.empty(len(amplitude)) for op in spectrum.SUMMARY_OPS}
            for one in np.unique(row_rates):
                here = row_rates == one
                for op, v in spectrum.summaries(amplitude[here] / np.sqrt(one), k, one).items():
                    found[op][here] = v
            return found

        data: dict[str, np.ndarray] = {}
        for c in linear_columns:
            values = dense(pdf[c].to_numpy(dtype=float))
            stats = _statistics(segments(values), ops) if ops else {}
            if spectral_ops:
                found = spectral(spectrum.amplitudes(np.nan_to_num(values, nan=0.0), k, 1.0)[where])
                stats |= {op: found[op] for op in spectral_ops}
            data.update({window_name(c, op): v for op, v in stats.items()})
        if circular_columns:
            here = dense(pdf[present].to_numpy(dtype=float)) == 1
            for c, low in circular_columns.items():
                values = np.where(here, dense(pdf[c].to_numpy(dtype=float)), np.nan)
                for op, v in _circular(segments(values), low, CIRCULAR_OPS).items():
                    data[window_name(c, op)] = np.where(here[where], v, np.nan)
        out = pdf.loc[own, kept].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(data, columns=names)], axis=1)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole pieces at a time; the last piece of a batch waits for its remaining rows."""
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = int(np.flatnonzero(_changes(rows, unit))[-1])
            held = rows.iloc[cut:]
            for part in _parts(rows.iloc[:cut], unit, piece):
                yield compute(part)
        if held is not None and len(held):
            yield compute(held)

    halo = with_halo(rows, frame, k, k, piece)
    ordered = halo.repartition(*unit).sortWithinPartitions(*unit, frame)
    return missing_to_null(ordered.mapInPandas(stream, schema), names)


def _changes(pdf: pd.DataFrame, unit: Sequence[str]) -> np.ndarray:
    """True on the first row of every (keys, piece)."""
    out = np.zeros(len(pdf), dtype=bool)
    out[:1] = True
    for c in unit:
        values = pdf[c].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def _parts(pdf: pd.DataFrame, unit: Sequence[str], rows: int) -> Iterator[pd.DataFrame]:
    """Cut between pieces into parts of about ``rows`` rows, which bounds the output at a time."""
    starts = np.append(np.flatnonzero(_changes(pdf, unit)), len(pdf)) if len(pdf) else np.array([0])
    begin = 0
    for end, following in zip(starts[1:], np.append(starts[2:], len(pdf) + rows + 1)):
        if following - begin > rows:
            yield pdf.iloc[begin:end].reset_index(drop=True)
            begin = end
