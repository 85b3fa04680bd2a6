"""Spectrum of a feature in a sliding window, and its summaries.

Detrending, tapering and the Fourier sum over 2k+1 samples are one fixed linear map. ``spectra``
applies it as column expressions; ``window_matrix`` uses the numpy form for wide tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.operators.frames import sliding
from ethospark.operators.windows import check_sizes, missing_to_null, quoted
from ethospark.skeleton import BANDS, DEFAULT_FPS

SUMMARY_OPS = [f"fft_band-{lo}Hz-{hi}Hz" for lo, hi in BANDS] + [
    "psd_sum", "psd_max", "psd_min", "psd_mean", "psd_std_dev", "psd_skew", "psd_kurtosis",
    "psd_median", "psd_top_freq",
]


def frequencies(k: int, fps: float) -> np.ndarray:
    """Bin centres in Hz."""
    return np.arange(k + 1) * fps / (2 * k + 1)


def transform_matrix(k: int, fps: float) -> np.ndarray:
    """Complex (2k+1) x (k+1) map: remove line, periodic Hann taper, DFT, density scaling."""
    n = 2 * k + 1
    t = np.arange(-k, k + 1, dtype=float)
    line = np.full((n, n), 1.0 / n) + np.outer(t, t) / (t @ t)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(k + 1)) / n)
    shape = taper[:, None] * wave / np.sqrt(fps * (taper @ taper))
    return (np.eye(n) - line) @ shape


def amplitudes(values: np.ndarray, k: int, fps: float) -> np.ndarray:
    """|spectrum| per sample of a dense vector; the ends are padded with zeros."""
    padded = np.pad(values, k)
    segments = np.lib.stride_tricks.sliding_window_view(padded, 2 * k + 1)
    return np.abs(segments @ transform_matrix(k, fps))


def summaries(amplitude: np.ndarray, k: int, fps: float) -> dict[str, np.ndarray]:
    """Band means and whole-spectrum statistics, one value per row; NaN where undefined."""
    freq = frequencies(k, fps)
    out: dict[str, np.ndarray] = {}
    for lo, hi in BANDS:
        inside = (freq >= lo) & (freq < hi)
        mean = amplitude[:, inside].mean(axis=1) if inside.any() else np.full(len(amplitude), np.nan)
        out[f"fft_band-{lo}Hz-{hi}Hz"] = mean
    mean = amplitude.mean(axis=1)
    apart = amplitude - mean[:, None]
    m2, m3, m4 = ((apart**p).mean(axis=1) for p in (2, 3, 4))
    flat = m2 <= (np.finfo(float).eps * mean) ** 2
    safe = np.where(flat, np.nan, m2)
    out["psd_sum"] = amplitude.sum(axis=1)
    out["psd_max"] = amplitude.max(axis=1)
    out["psd_min"] = amplitude.min(axis=1)
    out["psd_mean"] = mean
    out["psd_std_dev"] = np.sqrt(m2)
    out["psd_skew"] = m3 / safe**1.5
    out["psd_kurtosis"] = m4 / safe**2 - 3
    out["psd_median"] = np.median(amplitude, axis=1)
    out["psd_top_freq"] = freq[amplitude.argmax(axis=1)]
    return out


def spectra(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    column: str,
    fps: float | str = DEFAULT_FPS,
    frame: str = "frame",
) -> DataFrame:
    """Add ``spectrum``: the amplitude array (k+1 bins) of each frame, inside the JVM.

    ``fps`` is one number or the column that has each video's. Meant for one or a few columns; ``window_matrix`` is the path for wide tables.
    """
    (k,) = check_sizes([k])
    matrix, density = transform_matrix(k, 1.0), F.sqrt(_rate(fps))
    rows = missing_to_null(df, [column])

    def make(spec):
        around = spec.rangeBetween(-k, k)
        sample = F.struct(
            F.col(frame).cast("int").alias("f"), F.coalesce(quoted(column), F.lit(0.0)).alias("x")
        )
        return {"_samples": F.collect_list(sample).over(around)}

    def part(weights: np.ndarray):
        table = F.array(*[F.lit(float(w)) for w in weights])
        return F.aggregate(
            "_samples",
            F.lit(0.0),
            lambda total, s: total + s["x"] * F.get(table, s["f"] - F.col(frame).cast("int") + k),
        )

    bins = F.array(*[F.hypot(part(matrix[:, i].real), part(matrix[:, i].imag)) / density for i in range(k + 1)])
    return sliding(rows, keys, frame, k, k, make).withColumn("spectrum", bins).drop("_samples")


def _rate(fps: float | str) -> Column:
    return quoted(fps).cast("double") if isinstance(fps, str) else F.lit(float(fps))


def summary_columns(k: int, fps: float | str = DEFAULT_FPS, spectrum: str = "spectrum") -> dict[str, Column]:
    """Band means and whole-spectrum statistics of a ``spectrum`` column; NULL where undefined."""
    p, fps = F.col(spectrum), _rate(fps)
    n = k + 1
    hertz = lambda i: i * fps / (2 * k + 1)

    def mean(values: Column, count: int | Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / count

    def within(lo: float, hi: float) -> Callable[[Column, Column], Column]:
        return lambda x, i: (hertz(i) >= lo) & (hertz(i) < hi)

    out: dict[str, Column] = {}
    for lo, hi in BANDS:
        band = F.filter(p, within(lo, hi))
        out[f"fft_band-{lo}Hz-{hi}Hz"] = F.when(F.size(band) > 0, mean(band, F.size(band)))
    centre = mean(p, n)
    moment = lambda power: mean(F.transform(p, lambda x: F.pow(x - centre, F.lit(power))), n)
    spread = moment(2.0)
    flat = spread <= F.pow(np.finfo(float).eps * centre, F.lit(2.0))
    ordered = F.array_sort(p)
    out["psd_sum"] = centre * n
    out["psd_max"] = F.array_max(p)
    out["psd_min"] = F.array_min(p)
    out["psd_mean"] = centre
    out["psd_std_dev"] = F.sqrt(spread)
    out["psd_skew"] = F.when(~flat, moment(3.0) / F.pow(spread, F.lit(1.5)))
    out["psd_kurtosis"] = F.when(~flat, moment(4.0) / (spread * spread) - 3)
    out["psd_median"] = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    top = F.array_position(p, F.array_max(p)).cast("int") - 1
    out["psd_top_freq"] = hertz(top)
    return out
