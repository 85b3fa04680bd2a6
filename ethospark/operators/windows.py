"""Sliding-window statistics of feature columns.

Window size ``k`` means the 2k+1 frames centred on a frame, cut at the ends of the video. Missing
values are skipped. Feature columns are named ``module feature``; window columns
``module op feature``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ethospark.operators.frames import sliding

LINEAR_OPS = ["mean", "median", "std_dev", "skew", "kurtosis", "max", "min"]
CIRCULAR_OPS = ["mean", "std_dev"]


def window_name(feature: str, op: str) -> str:
    """``module feature`` → ``module op feature``."""
    module, _, rest = feature.partition(" ")
    return f"{module} {op} {rest}" if rest else f"{module} {op}"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def missing_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN → NULL; aggregates skip NULL but are poisoned by NaN."""
    wanted = set(columns)
    text = "nanvl(double(`{0}`), CAST(NULL AS DOUBLE)) AS `{0}`"
    return df.selectExpr(*[text.format(c) if c in wanted else f"`{c}`" for c in df.columns])


def linear(column: Column, spec: WindowSpec, op: str) -> Column:
    """One statistic of the values in the window; NULL when it has none (or no spread)."""
    if op == "mean":
        return F.avg(column).over(spec)
    if op == "median":
        return F.percentile(column, 0.5).over(spec)
    if op == "std_dev":
        return F.stddev_pop(column).over(spec)
    if op == "skew":
        return F.skewness(column).over(spec)
    if op == "kurtosis":  # not excess: Spark subtracts 3
        return F.kurtosis(column).over(spec) + 3
    if op == "max":
        return F.max(column).over(spec)
    if op == "min":
        return F.min(column).over(spec)
    raise ValueError(f"unknown window operation {op!r}")


def circular(column: Column, spec: WindowSpec, op: str, low: float) -> Column:
    """Mean direction in [low, low + 360) or circular standard deviation, in degrees."""
    sine = F.avg(F.sin(F.radians(column))).over(spec)
    cosine = F.avg(F.cos(F.radians(column))).over(spec)
    if op == "mean":
        degrees = F.degrees(F.atan2(sine, cosine))
        return degrees - 360 * F.floor((degrees - low) / 360).cast("double")
    if op == "std_dev":
        length = F.least(F.lit(1.0), F.sqrt(sine * sine + cosine * cosine))
        return F.degrees(F.sqrt(-2 * F.ln(length)))
    raise ValueError(f"unknown circular operation {op!r}")


def check_sizes(sizes: Sequence[int]) -> list[int]:
    """Window sizes of one run: each at least 1, sorted, without repeats."""
    if any(isinstance(s, bool) or not isinstance(s, int) or s < 1 for s in sizes):
        raise ValueError(f"window sizes must be integers >= 1: {list(sizes)}")
    return sorted(set(sizes))


def window_features(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    linear_columns: Sequence[str] = (),
    circular_columns: Sequence[str] = (),
    low: float = -180.0,
    ops: Sequence[str] = tuple(LINEAR_OPS),
    circular_ops: Sequence[str] = tuple(CIRCULAR_OPS),
    present: str | None = None,
    frame: str = "frame",
) -> DataFrame:
    """Keys, frame and one column per (feature, operation) for window size ``k``.

    ``present`` names a BOOLEAN column: circular statistics use only frames with the animal
    present, and are NULL on frames without it. All columns share one window pass.
    """
    (k,) = check_sizes([k])
    inputs = [*linear_columns, *circular_columns]
    df = missing_to_null(df.select(*keys, frame, *([present] if present else []), *map(quoted, inputs)), inputs)

    def make(spec: WindowSpec) -> dict[str, Column]:
        around = spec.rangeBetween(-k, k)
        out = {
            window_name(c, op): linear(quoted(c), around, op) for c in linear_columns for op in ops
        }
        for c in circular_columns:
            value = F.when(F.col(present), quoted(c)) if present else quoted(c)
            for op in circular_ops:
                result = circular(value, around, op, low)
                out[window_name(c, op)] = F.when(F.col(present), result) if present else result
        return out

    wide = sliding(df, keys, frame, k, k, make)
    names = [window_name(c, op) for c in linear_columns for op in ops]
    names += [window_name(c, op) for c in circular_columns for op in circular_ops]
    return wide.select(*keys, frame, *map(quoted, names))
