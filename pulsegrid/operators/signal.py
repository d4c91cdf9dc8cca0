"""Zero-phase band-pass over chunked recordings and dominant periods."""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import pin

LOW_HZ, HIGH_HZ, ORDER = 0.5, 40.0, 4
EDGE_PAD = 3 * (2 * ORDER + 1)


def bandpass_sections(fs: float) -> np.ndarray:
    """Second-order sections of the Butterworth band-pass, by the bilinear transform."""
    nyquist = 0.5 * fs
    band = np.array([LOW_HZ, min(HIGH_HZ, 0.9 * nyquist)]) / nyquist
    w1, w2 = 4.0 * np.tan(np.pi * band / 2.0)
    k = np.arange(1, ORDER + 1)
    low = np.exp(1j * np.pi * (2 * k + ORDER - 1) / (2 * ORDER))
    half = low * (w2 - w1) / 2.0
    shift = np.sqrt(half * half - w1 * w2 + 0j)
    z = (4.0 + np.concatenate([half + shift, half - shift]))
    z = z / (4.0 - np.concatenate([half + shift, half - shift]))
    upper = sorted((p for p in z if p.imag > 0), key=abs)
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2.0 * p.real, abs(p) ** 2] for p in upper])
    mid = np.exp(1j * 2.0 * np.arctan(np.sqrt(w1 * w2) / 4.0))
    gain = np.prod([np.abs(np.polyval(s[:3], mid) / np.polyval(s[3:], mid)) for s in sections])
    sections[0, :3] /= gain
    return sections


def settle_samples(fs: float, level: float = 1e-13) -> int:
    """Samples until the slowest pole has decayed to ``level``."""
    radius = max(np.sqrt(s[5]) for s in bandpass_sections(fs))
    return int(np.ceil(np.log(level) / np.log(radius)))


@functools.lru_cache(maxsize=16)
def _step_maps(fs: float):
    """One sample of all sections as (A, b, c, d): state' = A state + b x, y = c state + d x."""
    sections = bandpass_sections(fs)
    n = 2 * len(sections)
    # every column follows the state and the sample through the sections
    state, x = np.eye(n, n + 1), np.eye(1, n + 1, n)[0]
    out = np.empty_like(state)
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = b0 * x + state[2 * i]
        out[2 * i] = b1 * x - a1 * y + state[2 * i + 1]
        out[2 * i + 1] = b2 * x - a2 * y
        x = y
    return out[:, :n], out[:, n], x[:n], x[n]


def steady_state(fs: float) -> np.ndarray:
    """The state that a constant input of one settles in."""
    level, out = 1.0, []
    for b0, b1, b2, _, a1, a2 in bandpass_sections(fs):
        gain = (b0 + b1 + b2) / (1.0 + a1 + a2)
        out += [(gain - b0) * level, (b2 - a2 * gain) * level]
        level *= gain
    return np.array(out)


@functools.lru_cache(maxsize=64)
def _chunk_maps(fs: float, n: int):
    """n samples as maps: (A^n, state from the samples, output from the state, impulse response)."""
    a, b, c, d = _step_maps(fs)
    reach, seen, power = np.empty((n, len(b))), np.empty((n, len(b))), np.eye(len(b))
    for i in range(n):
        reach[n - 1 - i], seen[i], power = power @ b, c @ power, a @ power
    return power, reach, seen, np.concatenate([[d], seen[:-1] @ b])


def _response_to(x, impulse):
    """Output of a chunk from the zero state: the causal convolution, cut at its length."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(impulse, size), size, axis=1)[:, :n]


def _by_length(pdf):
    """(fs, length, row numbers) of the rows of a batch that share both."""
    n = pdf["values"].map(len).to_numpy()
    for (fs, size), at in pd.Series(np.arange(len(pdf))).groupby([pdf["fs"].to_numpy(), n]):
        yield float(fs), int(size), at.to_numpy()


def _matrix(column, rows):
    return np.stack([np.asarray(column.iloc[i], dtype=np.float64) for i in rows])


def _filtered(x, state, fs):
    _, _, seen, impulse = _chunk_maps(fs, x.shape[1])
    return _response_to(x, impulse) + state @ seen.T


def zero_phase(x: np.ndarray, fs: float) -> np.ndarray:
    """Forward and backward filtering of equally long rows."""
    for _ in range(2):
        x = _filtered(x, x[:, :1] * steady_state(fs), fs)[:, ::-1]
    return x


_PARTS = "record, lead, chunk"


def _end_states(batches):
    """What a chunk adds to the filter state; the first chunk starts settled on its first value."""
    for pdf in batches:
        state = np.zeros((len(pdf), 2 * ORDER))
        for fs, n, at in _by_length(pdf):
            x = _matrix(pdf["values"], at)
            power, reach, _, _ = _chunk_maps(fs, n)
            first = (pdf["chunk"].to_numpy()[at] == 0)[:, None]
            state[at] = x @ reach + (first * x[:, :1] * steady_state(fs)) @ power.T
        yield pdf[["record", "lead", "chunk", "fs"]].assign(n=pdf["values"].map(len), state=list(state))


def _composed(batches):
    """The map of a run of chunks after that of the run before it."""
    for pdf in batches:
        state = np.stack(pdf["state"].to_numpy()) if len(pdf) else np.empty((0, 2 * ORDER))
        n, before_n = pdf["n"].to_numpy().copy(), pdf["n0"].to_numpy()
        met = pdf["state0"].notna().to_numpy()
        for (fs, size), at in pd.Series(np.arange(len(pdf)))[met].groupby([pdf["fs"].to_numpy()[met], n[met]]):
            rows = at.to_numpy()
            power = np.linalg.matrix_power(_step_maps(float(fs))[0], int(size))
            state[rows] += _matrix(pdf["state0"], rows) @ power.T
            n[rows] += before_n[rows].astype(np.int64)
        yield pdf[["record", "lead", "chunk", "fs"]].assign(n=n, state=list(state))


def _run_from(batches):
    for pdf in batches:
        out = [None] * len(pdf)
        for fs, _, at in _by_length(pdf):
            x = _matrix(pdf["values"], at)
            state = np.stack([np.zeros(2 * ORDER) if pdf["state"].iloc[i] is None else np.asarray(pdf["state"].iloc[i]) for i in at])
            first = (pdf["chunk"].to_numpy()[at] == 0)[:, None]
            y = _filtered(x, np.where(first, x[:, :1] * steady_state(fs), state), fs)
            for i, row in zip(at, y):
                out[i] = row
        yield pdf[["record", "lead", "chunk", "fs"]].assign(values=out)


def _one_way(rows: DataFrame, steps: int) -> DataFrame:
    """Causal filtering of (record, lead, chunk, fs, values) by a prefix scan over the chunks' maps.

    A chunk maps the state s to A^n s + v. Runs of 1, 2, 4, .. chunks are composed, so after ``steps`` rounds
    ``state`` is what enters the next chunk.
    """
    key = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = f"record {key['record']}, lead {key['lead']}, chunk bigint, fs double"
    schema = f"{keys}, n bigint, state array<double>"
    ends = pin(rows.mapInPandas(_end_states, schema))
    for k in range(steps):
        before = ends.select("record", "lead", (F.col("chunk") + 2 ** k).alias("chunk"), F.col("n").alias("n0"), F.col("state").alias("state0"))
        ends = pin(ends.join(before, _PARTS.split(", "), "left").mapInPandas(_composed, schema))
    enters = ends.select("record", "lead", (F.col("chunk") + 1).alias("chunk"), "state")
    return rows.join(enters, _PARTS.split(", "), "left").mapInPandas(_run_from, f"{keys}, values array<double>")


def bandpass(signals: DataFrame) -> DataFrame:
    """Zero-phase band-pass per recording and lead, as a scan of affine maps of the filter state.

    Chunks may have any lengths but are numbered from 0 without gaps, ``start_idx`` is the place of the first value.
    Each chunk is filtered once in each direction from the state that the chunks before it leave; no chunk is copied
    to others and no task holds more than its batch. The ends of a recording get an odd reflection.
    Rounds of the scan go until runs of chunks span a response below 1e-18, at most the logarithm of the number of chunks.
    """
    keys = _PARTS.split(", ")
    chunks = pin(signals.groupBy("record", "lead").agg(
        F.max("chunk").cast("long").alias("last"), F.count(F.lit(1)).alias("n_chunks"), F.max(F.col("start_idx") + F.size("values")).alias("total"),
        F.min(F.size("values")).alias("least"), F.min("fs").alias("fs")))
    longest, gaps, least, rates = chunks.agg(
        F.max("n_chunks"), F.sum((F.col("n_chunks") != F.col("last") + 1).cast("int")), F.min(F.when(F.col("n_chunks") > 2, F.col("least"))),
        F.collect_set("fs")).first()
    if gaps:
        raise ValueError(f"{gaps} recordings whose chunks are not numbered from 0 without gaps")
    spans = max([settle_samples(fs, 1e-18) // max(1, least or 1) + 2 for fs in rates], default=1)
    steps = int(np.ceil(np.log2(max(1, min(longest or 1, spans)))))

    # the first and last values of a recording, reflected about its ends, join the chunks at the ends
    placed = signals.select("record", "lead", "start_idx", "values").join(chunks.select("record", "lead", "last", "total"), ["record", "lead"])
    at = F.col("start_idx") + F.col("i")
    near = placed.where((F.col("start_idx") <= EDGE_PAD) | (F.col("start_idx") + F.size("values") >= F.col("total") - EDGE_PAD - 1)).select(
        "record", "lead", "last", "total", "start_idx", F.posexplode("values").alias("i", "x")).select("record", "lead", "last", "total", at.alias("at"), "x")
    pad = F.least(F.lit(EDGE_PAD), F.col("total") - 1)
    edges = near.where((F.col("at") <= pad) | (F.col("at") >= F.col("total") - 1 - pad)).groupBy("record", "lead", "last", "total").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x")))).alias("e"))
    edges = pin(edges.selectExpr(
        "record", "lead", "last", f"int(least({EDGE_PAD}, total - 1)) as pad",
        "transform(filter(e, z -> z.at <= least(%d, total - 1)), z -> z.x) as head" % EDGE_PAD,
        "transform(filter(e, z -> z.at >= total - 1 - least(%d, total - 1)), z -> z.x) as tail" % EDGE_PAD))
    left = edges.selectExpr("record", "lead", "0L as chunk", "pad as n_left", "transform(reverse(slice(head, 2, pad)), z -> 2 * head[0] - z) as before")
    right = edges.selectExpr("record", "lead", "last as chunk", "last as _last", "transform(reverse(slice(tail, 1, pad)), z -> 2 * element_at(tail, -1) - z) as after")
    none = F.array().cast("array<double>")
    rows = signals.withColumn("chunk", F.col("chunk").cast("long")).join(left, keys, "left").join(right, keys, "left").select(
        *keys, F.col("fs").cast("double").alias("fs"),
        F.concat(F.coalesce("before", none), F.col("values").cast("array<double>"), F.coalesce("after", none)).alias("values"))

    def turned(d):
        return d.join(chunks.select("record", "lead", "last"), ["record", "lead"]).select(
            "record", "lead", (F.col("last") - F.col("chunk")).alias("chunk"), "fs", F.reverse("values").alias("values"))

    there = pin(turned(_one_way(rows, steps)))
    back = turned(_one_way(there, steps)).select(*keys, F.col("values").alias("_y"))
    whole = signals.withColumnRenamed("chunk", "_chunk").withColumn("chunk", F.col("_chunk").cast("long")).join(back, keys).join(
        left.select(*keys, "n_left"), keys, "left")
    cut = F.slice("_y", F.coalesce("n_left", F.lit(0)) + 1, F.size("values"))
    return whole.withColumn("values", cut).withColumn("chunk", F.col("_chunk")).select(*signals.columns)


def amplitude_spectrum(series: DataFrame, value="series") -> DataFrame:
    """(freq, amplitude): mean FFT amplitude over rows; equally long rows, DC set to zero.

    Each batch is reduced to one sum per frequency before anything is shuffled.
    """

    def partial(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            amp = np.abs(np.fft.rfft(np.stack(pdf[value].to_numpy()).astype(np.float64), axis=1))
            yield pd.DataFrame({
                "freq": np.arange(amp.shape[1], dtype=np.int64), "s": amp.sum(axis=0),
                "n": np.full(amp.shape[1], len(pdf), dtype=np.int64)})

    sums = series.select(value).mapInPandas(partial, "freq long, s double, n long")
    return sums.groupBy("freq").agg((F.sum("s") / F.sum("n")).alias("amplitude")).withColumn(
        "amplitude", F.when(F.col("freq") == 0, F.lit(0.0)).otherwise(F.col("amplitude")))


def dominant_periods(series: DataFrame, length: int, top_k: int = 3, value="series") -> DataFrame:
    """The ``top_k`` frequencies by mean amplitude with period max(2, round(length/freq))."""
    k = min(top_k, length // 2)
    spec = amplitude_spectrum(series, value)
    return spec.orderBy(F.desc("amplitude"), "freq").limit(k).select(
        "freq", "amplitude",
        F.greatest(F.lit(2), F.bround(F.lit(float(length)) / F.col("freq"))).cast("long").alias("period"))
