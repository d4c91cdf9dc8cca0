"""Shape descriptors of a window and the assembled base feature row."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.schema import PRE_SAMPLES

EPS = 1e-8

DESCRIPTORS = [
    "peak", "trough", "span", "peak_at", "trough_at", "mean", "std", "mean_abs",
    "qrs_mean", "qrs_std", "qrs_energy", "energy", "left_energy", "right_energy", "energy_ratio",
    "rise_max", "rise_min", "rise_span", "rise_energy", "sign_changes",
    "qrs_over_30", "qrs_over_50", "st_mean", "st_std", "qrs_sum", "qrs_abs_sum",
]

# Zone offsets around the event, in samples.
QRS = (-45, 55)
ST = (25, 100)


def _safe(c: Column, x: Column) -> Column:
    return F.when(F.size(x) > 0, c).otherwise(F.lit(0.0))


def shape_descriptors(x: Column, center=PRE_SAMPLES, qrs=QRS, st=ST) -> Column:
    """26 descriptors of one window as built-in array expressions."""
    c = center
    parts = F.struct(
        x.alias("x"), A.zone(x, 0, c).alias("left"), F.slice(x, c + 1, F.greatest(F.size(x) - c, F.lit(0))).alias("right"),
        A.zone(x, c + qrs[0], c + qrs[1]).alias("q"), A.zone(x, c + st[0], c + st[1]).alias("s"), A.diff(x).alias("dx"))

    def describe(p):
        x, q, s, dx = p["x"], p["q"], p["s"], p["dx"]
        negative = F.transform(x, lambda v: F.when(v < 0, 1.0).otherwise(0.0))
        changes = A.mean(F.transform(A.diff(negative), lambda v: F.abs(v)))

        def share(level):
            return A.let(level * (F.array_max(F.transform(q, lambda v: F.abs(v))) + F.lit(EPS)), lambda edge: A.mean(
                F.transform(q, lambda v: F.when(F.abs(v) > edge, 1.0).otherwise(0.0))))

        hi, lo, dhi, dlo = F.array_max(x), F.array_min(x), F.array_max(dx), F.array_min(dx)
        left_e, right_e = A.mean_square(p["left"]), A.mean_square(p["right"])
        return F.array(
            hi, lo, hi - lo,
            (A.argmax(x) - c).cast("double"), (A.argmin(x) - c).cast("double"),
            A.mean(x), A.pop_std(x), A.mean_abs(x),
            A.mean(q), A.pop_std(q), A.mean_square(q), A.mean_square(x), left_e, right_e,
            left_e / (right_e + F.lit(EPS)),
            dhi, dlo, dhi - dlo, A.mean_square(dx), changes, share(0.3), share(0.5),
            _safe(A.mean(s), s), _safe(A.pop_std(s), s), A.total(q), A.total(F.transform(q, lambda v: F.abs(v))),
        )

    return A.let(parts, describe)


def _batch_descriptors(x, c, qrs, st):
    """The same 26 descriptors for all rows of a batch of equally long windows."""
    n, t = x.shape
    q = x[:, max(0, c + qrs[0]):min(t, c + qrs[1])]
    s = x[:, min(t, c + st[0]):min(t, c + st[1])]
    dx, q_abs = np.diff(x, axis=1), np.abs(q)
    level = q_abs.max(axis=1, keepdims=True) + EPS
    zero = np.zeros(n)

    def ms(a):
        return (a * a).mean(axis=1)

    cols = [
        x.max(1), x.min(1), x.max(1) - x.min(1), x.argmax(1) - c, x.argmin(1) - c,
        x.mean(1), x.std(1), np.abs(x).mean(1), q.mean(1), q.std(1), ms(q), ms(x),
        ms(x[:, :c]), ms(x[:, c:]), ms(x[:, :c]) / (ms(x[:, c:]) + EPS),
        dx.max(1), dx.min(1), dx.max(1) - dx.min(1), ms(dx),
        np.diff(x < 0, axis=1).mean(1), (q_abs > 0.3 * level).mean(1), (q_abs > 0.5 * level).mean(1),
        s.mean(1) if s.shape[1] else zero, s.std(1) if s.shape[1] else zero,
        q.sum(1), q_abs.sum(1),
    ]
    return np.stack(cols, axis=1).astype(np.float64)


def _by_length(vec: pd.Series):
    """(row positions, matrix) per window length of a batch; one rate gives one length."""
    sizes = vec.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.stack(vec.to_numpy()[at]).astype(np.float64)


def _lerp_rows(x: np.ndarray, points: int) -> np.ndarray:
    pos = np.arange(points) * (x.shape[1] - 1) / max(points - 1, 1)
    left = np.minimum(np.floor(pos).astype(int), x.shape[1] - 1)
    right = np.minimum(left + 1, x.shape[1] - 1)
    return x[:, left] + (x[:, right] - x[:, left]) * (pos - left)


def resample_batch(points: int):
    """Arrow-batched linear resampling, for long windows; null stays null."""

    @F.pandas_udf("array<double>")
    def run(vec: pd.Series) -> pd.Series:
        out = np.empty(len(vec), dtype=object)
        given = np.flatnonzero(vec.notna())
        for at, x in _by_length(vec.iloc[given]):
            for i, row in zip(given[at], _lerp_rows(x, points)):
                out[i] = row
        return pd.Series(out)

    return run


def shape_descriptors_batch(center=PRE_SAMPLES, qrs=QRS, st=ST):
    """Arrow-batched form for long windows, where array expressions are interpreted per value."""

    @F.pandas_udf("array<double>")
    def run(vec: pd.Series) -> pd.Series:
        out = np.empty(len(vec), dtype=object)
        for at, x in _by_length(vec):
            for i, row in zip(at, _batch_descriptors(x, center, qrs, st)):
                out[i] = row
        return pd.Series(out)

    return run


def _batch_wave(center, wave_points, slope_points):
    """Everything of the base row but the intervals, in one pass over both windows."""

    @F.pandas_udf("array<double>")
    def run(b0: pd.Series, b1: pd.Series) -> pd.Series:
        out = np.empty(len(b0), dtype=object)
        for at, x in _by_length(b0):
            z = np.stack(b1.to_numpy()[at]).astype(np.float64)
            m0, m1 = (_batch_descriptors(w, center, QRS, ST) for w in (x, z))
            full = np.concatenate([
                m0, m1, m0 - m1, _lerp_rows(x, wave_points), _lerp_rows(z, wave_points),
                _lerp_rows(np.diff(x, axis=1), slope_points), _lerp_rows(np.diff(z, axis=1), slope_points)], axis=1)
            for i, row in zip(at, full):
                out[i] = row
        return pd.Series(out)

    return run


def base_features(beats: DataFrame, rr="rr", center=PRE_SAMPLES, name="x", batched=True,
                  wave_points=80, slope_points=40) -> DataFrame:
    """Interval + shape (lead 0, lead 1, difference) + resampled wave and slope of both leads.

    ``batched`` computes the window part in Arrow batches; the other form is all built-ins.
    """
    if batched:
        wave = _batch_wave(center, wave_points, slope_points)
        return beats.withColumn(name, F.concat(F.col(rr), wave("b0", "b1")))
    b0, b1 = F.col("b0").cast("array<double>"), F.col("b1").cast("array<double>")
    rows = beats.withColumn("_m0", shape_descriptors(b0, center)).withColumn("_m1", shape_descriptors(b1, center))
    gap = F.zip_with("_m0", "_m1", lambda p, q: p - q)
    full = F.concat(
        F.col(rr), F.col("_m0"), F.col("_m1"), gap,
        A.resample(b0, wave_points), A.resample(b1, wave_points),
        A.resample(A.diff(b0), slope_points), A.resample(A.diff(b1), slope_points))
    return rows.withColumn(name, full).drop("_m0", "_m1")
