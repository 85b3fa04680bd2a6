"""Sliding-window statistics, circular statistics and spectra of a feature column."""

from pyspark.sql import functions as F

from ethospark.operators import spectrum as S
from ethospark.operators import windows as W
from ethospark.operators.window_matrix import window_matrix as window_matrix_of
from ethospark.plans.registry import query, rounded

KEYS = ["video", "identity"]
K = 5
_AROUND = f"""(PARTITION BY video, identity ORDER BY frame
              RANGE BETWEEN {K} PRECEDING AND {K} FOLLOWING)"""


def _named(df, prefix: str, ops):
    """Shorten ``signal <op> value`` to the operation for the result."""
    clean = lambda op: op.replace("-", "_").replace(".", "p")
    return df.select(
        *KEYS, "frame", *[rounded(W.quoted(W.window_name(prefix, op))).alias(clean(op)) for op in ops]
    )


@query(
    "window_statistics",
    f"""WITH lists AS (
        SELECT video, identity, frame,
               list(value) FILTER (value IS NOT NULL) OVER {_AROUND} AS l FROM v_signal),
    moments AS (
        SELECT *, list_avg(l) AS m, len(l) AS n,
               list_sum(list_transform(l, lambda x: power(x - list_avg(l), 2))) / len(l) AS m2,
               list_sum(list_transform(l, lambda x: power(x - list_avg(l), 3))) / len(l) AS m3,
               list_sum(list_transform(l, lambda x: power(x - list_avg(l), 4))) / len(l) AS m4
        FROM lists)
    SELECT video, identity, frame, round(m, 6) AS mean, round(list_median(l), 6) AS median,
           round(sqrt(m2), 6) AS std_dev,
           CASE WHEN m2 > 0 THEN round(m3 / power(m2, 1.5), 6) END AS skew,
           CASE WHEN m2 > 0 THEN round(m4 / (m2 * m2), 6) END AS kurtosis,
           round(list_max(l), 6) AS max, round(list_min(l), 6) AS min
    FROM moments""",
)
def window_statistics(v):
    signal = v.signal().withColumnRenamed("value", "signal value")
    return _named(
        W.window_features(signal, KEYS, K, ["signal value"]), "signal value", W.LINEAR_OPS
    )


def _circular_sql(low: int) -> str:
    return f"""WITH sums AS (
        SELECT video, identity, frame, value,
               avg(sin(radians(value))) OVER {_AROUND} AS s,
               avg(cos(radians(value))) OVER {_AROUND} AS c FROM v_angle),
    directions AS (SELECT *, degrees(atan2(s, c)) AS d, least(1, sqrt(s * s + c * c)) AS r FROM sums)
    SELECT video, identity, frame,
           CASE WHEN value IS NOT NULL THEN round(d - 360 * floor((d - ({low})) / 360), 6) END AS mean,
           CASE WHEN value IS NOT NULL THEN round(degrees(sqrt(-2 * ln(r))), 6) END AS std_dev
    FROM directions"""


def _circular(v, low):
    angle = v.angle().withColumnRenamed("value", "angle value")
    angle = angle.withColumn("present", W.quoted("angle value").isNotNull())
    out = W.window_features(
        angle, KEYS, K, circular_columns=["angle value"], low=low, present="present"
    )
    return _named(out, "angle value", W.CIRCULAR_OPS)


@query("window_circular_bearing", _circular_sql(-180))
def window_circular_bearing(v):
    return _circular(v, -180.0)


@query("window_circular_angle", _circular_sql(0))
def window_circular_angle(v):
    return _circular(v, 0.0)


# Σ of squared periodic Hann weights over n samples is 3n/8; frames outside the video count as 0.
_N = 2 * K + 1
_SPECTRUM = f"""WITH samples AS (
        SELECT a.video, a.identity, a.frame, o.j, coalesce(b.value, 0) AS x
        FROM v_signal a CROSS JOIN (SELECT unnest(range(-{K}, {K} + 1)) AS j) o
        LEFT JOIN v_signal b ON b.video = a.video AND b.identity = a.identity
                            AND b.frame = a.frame + o.j),
    lines AS (
        SELECT video, identity, frame, avg(x) AS mean, sum(j * x) / sum(j * j) AS slope
        FROM samples GROUP BY ALL),
    tapered AS (
        SELECT video, identity, frame, j + {K} AS m,
               (x - mean - slope * j) * (0.5 - 0.5 * cos(2 * pi() * (j + {K}) / {_N})) AS y
        FROM samples JOIN lines USING (video, identity, frame)),
    bins AS (
        SELECT video, identity, frame, i,
               sqrt(power(sum(y * cos(2 * pi() * i * m / {_N})), 2)
                    + power(sum(y * sin(2 * pi() * i * m / {_N})), 2))
                 / sqrt(30 * 3 * {_N} / 8) AS a,
               i * 30.0 / {_N} AS hz
        FROM tapered CROSS JOIN (SELECT unnest(range(0, {K} + 1)) AS i) GROUP BY ALL)"""


@query(
    "window_spectrum",
    _SPECTRUM
    + """ SELECT video, identity, frame, i AS bin, round(hz, 6) AS hz, round(a, 6) AS amplitude
          FROM bins""",
)
def window_spectrum(v):
    frequencies = F.array(*[F.lit(float(f)) for f in S.frequencies(K, 30.0)])
    return (
        S.spectra(v.signal(), KEYS, K, "value")
        .select(*KEYS, "frame", F.posexplode("spectrum").alias("bin", "amplitude"))
        .select(
            *KEYS, "frame", F.col("bin").cast("bigint").alias("bin"),
            rounded(F.get(frequencies, "bin")).alias("hz"), rounded("amplitude").alias("amplitude"),
        )
    )


_BAND_SQL = ",\n".join(
    f"round(avg(a) FILTER (hz >= {lo} AND hz < {hi}), 6) AS "
    f"{f'fft_band-{lo}Hz-{hi}Hz'.replace('-', '_').replace('.', 'p')}"
    for lo, hi in S.BANDS
)


@query(
    "window_spectral_features",
    _SPECTRUM
    + f""", centred AS (
        SELECT *, a - avg(a) OVER (PARTITION BY video, identity, frame) AS d FROM bins)
    SELECT video, identity, frame, {_BAND_SQL},
           round(sum(a), 6) AS psd_sum, round(max(a), 6) AS psd_max, round(min(a), 6) AS psd_min,
           round(avg(a), 6) AS psd_mean, round(sqrt(avg(d * d)), 6) AS psd_std_dev,
           round(avg(power(d, 3)) / power(avg(d * d), 1.5), 6) AS psd_skew,
           round(avg(power(d, 4)) / power(avg(d * d), 2) - 3, 6) AS psd_kurtosis,
           round(median(a), 6) AS psd_median, round(arg_max(hz, a), 6) AS psd_top_freq
    FROM centred GROUP BY video, identity, frame""",
)
def window_spectral_features(v):
    rows = S.spectra(v.signal(), KEYS, K, "value")
    clean = lambda op: op.replace("-", "_").replace(".", "p")
    return rows.select(
        *KEYS, "frame", *[rounded(c).alias(clean(op)) for op, c in S.summary_columns(K).items()]
    )


# every second video at 15 frames per second
_RATE = "CASE WHEN video IN ('video1', 'video3', 'video5') THEN 15 ELSE 30 END"
_RATED = _SPECTRUM.replace("AS i) GROUP BY ALL)", "AS i) GROUP BY video, identity, frame, i)").replace("sqrt(30 * 3", f"sqrt({_RATE} * 3").replace("i * 30.0 /", f"i * {_RATE}::DOUBLE /")
_PER_RATE = [f"fft_band-{lo}Hz-{hi}Hz" for lo, hi in S.BANDS] + ["psd_sum", "psd_top_freq"]


def _rated(v):
    slow = F.col("video").isin("video1", "video3", "video5")
    return v.signal().withColumn("rate", F.when(slow, 15).otherwise(30))


@query(
    "window_spectral_rates",
    _RATED + f""" SELECT video, identity, frame, {_BAND_SQL}, round(sum(a), 6) AS psd_sum, round(arg_max(hz, a), 6) AS psd_top_freq
    FROM bins GROUP BY video, identity, frame""",
)
def window_spectral_rates(v):
    """Every video has its own frame rate: columns of one signal."""
    rows = S.spectra(_rated(v), KEYS, K, "value", "rate")
    found = S.summary_columns(K, "rate")
    return rows.select(*KEYS, "frame", *[rounded(found[op]).alias(op.replace("-", "_").replace(".", "p")) for op in _PER_RATE])


@query(
    "window_matrix_rates",
    _RATED + f""" SELECT video, identity, frame, {_BAND_SQL}, round(sum(a), 6) AS psd_sum, round(arg_max(hz, a), 6) AS psd_top_freq
    FROM bins GROUP BY video, identity, frame""",
)
def window_matrix_rates(v):
    """The same over the wide path."""
    rows = _rated(v).withColumnRenamed("value", "signal value")
    out = window_matrix_of(rows, KEYS, K, ["signal value"], ops=(), spectral_ops=_PER_RATE, fps="rate")
    names = {op: W.window_name("signal value", op) for op in _PER_RATE}
    return out.select(*KEYS, "frame", *[rounded(W.quoted(c)).alias(op.replace("-", "_").replace(".", "p")) for op, c in names.items()])


@query(
    "window_matrix",
    _SPECTRUM
    + f""", lists AS (
        SELECT video, identity, frame,
               list(value) FILTER (value IS NOT NULL) OVER {_AROUND} AS l FROM v_signal),
    turns AS (
        SELECT video, identity, frame, value, avg(sin(radians(value))) OVER {_AROUND} AS s,
               avg(cos(radians(value))) OVER {_AROUND} AS c FROM v_angle),
    tops AS (SELECT video, identity, frame, sum(a) AS psd_sum, arg_max(hz, a) AS psd_top_freq
             FROM bins GROUP BY ALL)
    SELECT video, identity, frame, round(list_avg(l), 6) AS mean, round(list_median(l), 6) AS median,
           round(list_max(l), 6) AS max, round(list_min(l), 6) AS min,
           round(sqrt(list_sum(list_transform(l, lambda x: power(x - list_avg(l), 2))) / len(l)), 6)
             AS std_dev,
           round(psd_sum, 6) AS psd_sum, round(psd_top_freq, 6) AS psd_top_freq,
           CASE WHEN value IS NOT NULL THEN
             round(degrees(sqrt(-2 * ln(least(1, sqrt(s * s + c * c))))), 6) END AS turn_std_dev
    FROM lists JOIN turns USING (video, identity, frame) JOIN tops USING (video, identity, frame)""",
)
def window_matrix(v):
    """The wide path: statistics, circular statistics and spectra of several columns in one pass."""
    rows = v.signal().withColumnRenamed("value", "signal value")
    turned = v.angle().withColumnRenamed("value", "angle value")
    both = rows.join(turned, [*KEYS, "frame"]).withColumn("present", W.quoted("angle value").isNotNull())
    out = window_matrix_of(
        both, KEYS, K, ["signal value"], {"angle value": -180.0},
        ops=["mean", "median", "max", "min", "std_dev"], spectral_ops=["psd_sum", "psd_top_freq"],
    )
    names = {op: W.window_name("signal value", op)
             for op in ["mean", "median", "max", "min", "std_dev", "psd_sum", "psd_top_freq"]}
    names["turn_std_dev"] = W.window_name("angle value", "std_dev")
    return out.select(*KEYS, "frame", *[rounded(W.quoted(c)).alias(n) for n, c in names.items()])
