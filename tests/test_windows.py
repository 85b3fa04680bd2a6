"""Window statistics and spectra."""

import math

import numpy as np
import pytest

from ethospark.operators import spectrum as S
from ethospark.operators import window_matrix as WM
from ethospark.operators import windows as W

KEY = ["identity"]


def table(out, name):
    return [r[name] for r in sorted(out, key=lambda r: r.frame)]


@pytest.mark.parametrize("op, values, k, expected", [
    ("mean", [1, 2, 3], 1, [1.5, 2, 2.5]),
    ("median", [1, 2, 10], 1, [1.5, 2, 6]),
    ("std_dev", [1, 3, 5], 1, [1, math.sqrt(8 / 3), 1]),
    ("min", [4, 1, 7, 2], 1, [1, 1, 1, 2]),
    ("max", [4, 1, 7, 2], 1, [4, 7, 7, 7]),
])
def test_literal_statistics(sequences, op, values, k, expected):
    df = sequences([[float(v) for v in values]], "value", "double").withColumnRenamed("value", "m x")
    out = W.window_features(df, KEY, k, ["m x"], ops=[op]).collect()
    assert table(out, f"m {op} x") == pytest.approx(expected)


def test_missing_and_constant_values(sequences):
    nan = float("nan")
    df = sequences([[nan] * 4, [2.0, nan, 2.0]], "value", "double").withColumnRenamed("value", "m x")
    rows = W.window_features(df, KEY, 1, ["m x"]).collect()
    for r in rows:
        if r.identity == 0:
            assert all(r[f"m {op} x"] is None for op in W.LINEAR_OPS)
        else:
            assert r["m mean x"] == 2.0 and r["m skew x"] is None and r["m kurtosis x"] is None


def test_skew_and_kurtosis_by_moments(sequences):
    values = np.array([1.0, 2, 8, 3, 5])
    df = sequences([values.tolist()], "value", "double").withColumnRenamed("value", "m x")
    middle = [r for r in W.window_features(df, KEY, 2, ["m x"]).collect() if r.frame == 2][0]
    d = values - values.mean()
    assert middle["m skew x"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert middle["m kurtosis x"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2)


def test_sizes():
    assert W.check_sizes([5, 2, 5]) == [2, 5]
    for bad in ([0], [1.5], [True]):
        with pytest.raises(ValueError):
            W.check_sizes(bad)


def test_transform_removes_lines():
    assert np.allclose(S.amplitudes(np.arange(40.0) * 3 + 7, 4, 30.0)[5:-5], 0, atol=1e-9)
    assert S.frequencies(5, 30.0)[-1] == pytest.approx(5 * 30 / 11)


def test_wide_path_equals_columns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for identity, n in enumerate([1, 3, 30, 600]):
        for f in range(n):
            x = None if rng.random() < 0.2 else float(rng.normal())
            rows.append((identity, f, x, float(rng.uniform(-180, 180)), bool(rng.random() < 0.8)))
    df = spark.createDataFrame(rows, "identity int, frame int, `m x` double, `m a` double, present boolean")
    k = 3
    # small Arrow batches and pieces: a piece arrives in several batches, a batch holds several
    monkeypatch.setattr(WM, "CELLS_PER_PIECE", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = WM.window_matrix(df, KEY, k, ["m x"], {"m a": -180.0}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wide = {(r.identity, r.frame): r for r in out}
    assert len(out) == len(wide)
    narrow = W.window_features(df, KEY, k, ["m x"], ["m a"], present="present").collect()
    spectral = S.spectra(df, KEY, k, "m x").select(
        "identity", "frame", *[c.alias(f"m {op} x") for op, c in S.summary_columns(k).items()]
    ).collect()
    assert len(wide) == len(narrow) == len(spectral) == len(rows)
    for r in [*narrow, *spectral]:
        for name in r.asDict():
            if name.startswith("m "):
                mine = wide[r.identity, r.frame][name]
                assert (mine is None) == (r[name] is None), name
                if mine is not None and not (name == "m psd_top_freq x" and r.identity < 2):
                    # (the spectrum of a single sample has ties, which rounding decides)
                    assert mine == pytest.approx(r[name], abs=1e-9), name


def test_circular_mean_wraps(spark):
    df = spark.createDataFrame([(0, 0, 170.0), (0, 1, -170.0)], "identity int, frame int, `m a` double")
    for low, expected in ((-180.0, -180.0), (0.0, 180.0)):
        out = W.window_features(df, KEY, 1, circular_columns=["m a"], low=low).collect()
        assert abs(abs(out[0]["m mean a"]) - abs(expected)) < 1e-9
        assert out[0]["m std_dev a"] == pytest.approx(
            math.degrees(math.sqrt(-2 * math.log(math.cos(math.radians(10)))))
        )


def test_direction_length_is_the_root_of_squares(spark):
    """Both paths round as the statement does, also where all angles of a window are equal."""
    for angle in (98.95099999999996, 1.46, 36.5, -17.9):
        df = spark.createDataFrame([(0, 0, angle, True)], "identity int, frame int, `m a` double, present boolean")
        s, c = math.sin(math.radians(angle)), math.cos(math.radians(angle))
        expected = math.degrees(math.sqrt(-2 * math.log(min(1.0, math.sqrt(s * s + c * c)))))
        wide = WM.window_matrix(df, KEY, 1, circular_columns={"m a": -180.0}).first()
        narrow = W.window_features(df, KEY, 1, circular_columns=["m a"], present="present").first()
        assert wide["m std_dev a"] == pytest.approx(expected, abs=1e-9) == narrow["m std_dev a"]


def test_names():
    assert W.window_name("angles angle A-B-C", "mean") == "angles mean angle A-B-C"
