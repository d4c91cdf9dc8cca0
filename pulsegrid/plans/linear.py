"""Linear classifiers of many runs fitted together by Newton steps on keyed sums.

Every step is one pass over the fit rows of all runs: tasks add up loss, gradient and curvature of each run at its current
coefficients, one aggregate by (run, slice of the sums) adds the tasks, and the driver solves one small system a run. The number of
Spark jobs depends on the steps (STEPS at most), not on the runs; a run that has converged contributes nothing to later passes.

- ``softmax``: multinomial logistic regression, sum of log losses + |w|^2 / 2, the intercept not penalised.
- ``squared_hinge``: one against the rest, sum of max(0, 1 - margin)^2 + |(w, intercept)|^2 / 2 for each class.

Features are standardised with mean and population deviation of the run's fit rows. Classes without fit rows get no probability
(softmax) or the score of a missing class. Rows without a class or with a null vector are not fitted. Sums of a run hold about
(classes * width)^2 numbers, whatever its rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.schema import N_CLASSES
from pulsegrid.session import pin

#: Steps at most, largest gradient entry of a converged run relative to its rows, numbers of a slice of the sums.
STEPS, TOLERANCE, SLICE = 60, 1e-9, 8_192
# Fixed value: score of a class that the model does not know.
MISSING = -1e6


def _rows_of(b):
    """Feature matrix of an Arrow batch's last column."""
    column = b.column(b.num_columns - 1)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _by_run(run):
    order = np.argsort(run, kind="stable")
    cuts = np.flatnonzero(np.diff(run[order])) + 1
    return [(int(run[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def _sums(parts: DataFrame) -> dict:
    """Adds (run, part, values) by run and part; {run: vector}."""
    def add(group):
        total = np.sum([np.asarray(v.values) for v in group.column("values").combine_chunks()], axis=0)
        return pa.table({"run": group.column("run")[:1], "part": group.column("part")[:1], "values": pa.array([total], pa.list_(pa.float64()))})

    schema = "run int, part int, values array<double>"
    out = {}
    for r in parts.groupBy("run", "part").applyInArrow(add, schema).collect():  # some slices a run
        out.setdefault(r["run"], {})[r["part"]] = r["values"]
    return {run: np.concatenate([np.asarray(p[i]) for i in sorted(p)]) for run, p in out.items()}


def _sliced(sums):
    """Record batch of the slices of {run: vector}."""
    rows = [(run, i // SLICE, v[i:i + SLICE]) for run, v in sums.items() for i in range(0, len(v), SLICE)]
    run, part, values = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(part, pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["run", "part", "values"])


PARTS = "run int, part int, values array<double>"


def _moments(data: DataFrame) -> dict:
    """{run: (class counts, mean, deviation)}."""
    def run(batches):
        sums = {}
        for b in batches:
            x, y = _rows_of(b), np.asarray(b.column(1))
            for r, rows in _by_run(np.asarray(b.column(0))):
                v = np.concatenate([np.bincount(y[rows], minlength=N_CLASSES).astype(float), x[rows].sum(0)])
                sums[r] = v + sums.get(r, 0.0)
        yield _sliced(sums)

    def spread(batches):
        sums = {}
        for b in batches:
            x = _rows_of(b)
            for r, rows in _by_run(np.asarray(b.column(0))):
                sums[r] = ((x[rows] - means[r]) ** 2).sum(0) + sums.get(r, 0.0)
        yield _sliced(sums)

    first = _sums(data.mapInArrow(run, PARTS))
    counts = {r: v[:N_CLASSES] for r, v in first.items()}
    means = {r: v[N_CLASSES:] / counts[r].sum() for r, v in first.items()}
    second = _sums(data.mapInArrow(spread, PARTS))
    deviations = {r: np.sqrt(v / counts[r].sum()) for r, v in second.items()}
    return {r: (counts[r], means[r], np.where(deviations[r] > 0, deviations[r], 1.0)) for r in counts}


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _softmax_sums(x, y, w):
    """(loss, gradient, curvature blocks) of the log loss over the classes of ``w`` (classes x width)."""
    z = x @ w.T
    top = z.max(1, keepdims=True)
    p = np.exp(z - top)
    total = p.sum(1, keepdims=True)
    p /= total
    hit = np.eye(len(w))[y]
    loss = (np.log(total[:, 0]) + top[:, 0] - z[np.arange(len(y)), y]).sum()
    blocks = [((p[:, c] * ((c == k) - p[:, k]))[:, None] * x).T @ x for c in range(len(w)) for k in range(c, len(w))]
    return np.concatenate([[loss], ((p - hit).T @ x).ravel(), *(b.ravel() for b in blocks)])


def _hinge_sums(x, y, w):
    """(losses, gradients, curvatures) of every class against the rest."""
    sign = 2 * np.eye(len(w))[y] - 1
    slack = np.maximum(0, 1 - sign * (x @ w.T))
    blocks = [2 * x[slack[:, c] > 0].T @ x[slack[:, c] > 0] for c in range(len(w))]
    return np.concatenate([(slack ** 2).sum(0), (-2 * (sign * slack).T @ x).ravel(), *(b.ravel() for b in blocks)])


class _Softmax:
    """State of one run; the last column of its coefficients is the intercept."""

    sums = staticmethod(_softmax_sums)

    def __init__(self, classes, width):
        self.w = self.base = np.zeros((len(classes), width))
        self.loss, self.step, self.done = np.inf, np.zeros_like(self.w), len(classes) < 2

    def take(self, v, n):
        """Newton step from the sums at ``w``; half the last step if it did not lower the loss."""
        c, d = self.w.shape
        loss, gradient = v[0] + (self.w[:, :-1] ** 2).sum() / 2, v[1:1 + c * d].reshape(c, d).copy()
        gradient[:, :-1] += self.w[:, :-1]
        if np.abs(gradient).max() <= TOLERANCE * n or np.abs(self.step).max(initial=0) < 1e-14 and np.isfinite(self.loss):
            self.done = True
            return
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.w = self.base + self.step
            return
        h, at = np.zeros((c, d, c, d)), 1 + c * d
        for i in range(c):
            for k in range(i, c):
                h[i, :, k, :] = v[at:at + d * d].reshape(d, d)
                h[k, :, i, :] = h[i, :, k, :].T
                at += d * d
        for i in range(c):
            h[i, np.arange(d - 1), i, np.arange(d - 1)] += 1
        h[:, -1, :, -1] += 1  # adding one number to all intercepts changes nothing: pick the smallest
        self.loss, self.base = loss, self.w
        self.step = -np.linalg.solve(h.reshape(c * d, c * d), gradient.ravel()).reshape(c, d)
        self.w = self.base + self.step


class _Hinge:
    """State of one run; classes are fitted side by side."""

    sums = staticmethod(_hinge_sums)

    def __init__(self, classes, width):
        self.w = self.base = np.zeros((len(classes), width))
        self.loss, self.step, self.done = np.full(len(classes), np.inf), np.zeros_like(self.w), len(classes) < 2

    def take(self, v, n):
        c, d = self.w.shape
        losses, gradients = v[:c] + (self.w ** 2).sum(1) / 2, v[c:c + c * d].reshape(c, d) + self.w
        curvature = v[c + c * d:].reshape(c, d, d) + np.eye(d)
        w, settled = self.w.copy(), True
        for i in range(c):
            if np.abs(gradients[i]).max() <= TOLERANCE * n:
                continue
            if losses[i] > self.loss[i] + 1e-12 * abs(self.loss[i]):
                self.step[i] /= 2
                settled &= np.abs(self.step[i]).max() < 1e-14
                w[i] = self.base[i] + self.step[i]
                continue
            settled = False
            self.loss[i] = losses[i]
            self.base[i], self.step[i] = self.w[i], -np.linalg.solve(curvature[i], gradients[i])
            w[i] = self.base[i] + self.step[i]
        self.w, self.done = w, settled


KINDS = {"softmax": _Softmax, "squared_hinge": _Hinge}


def fit(rows: DataFrame, keys, kind="softmax", features="features", y="y") -> list:
    """[(key values, classes, mean, deviation, coefficients)] of every run of ``rows``; the last coefficient is the intercept."""
    keys = list(keys)
    usable = rows.where(F.col(y).isNotNull() & F.col(features).isNotNull())
    runs = [tuple(r) for r in usable.select(*keys).distinct().collect()]  # the run grid
    if not runs:
        return []
    spark = rows.sparkSession
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(runs)], T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys]
                                                                                        + [T.StructField("_run", T.IntegerType())]))
    same = [rows[k].eqNullSafe(numbered[k]) for k in keys]
    data = pin(usable.join(F.broadcast(numbered), same).select("_run", F.col(y).cast("int").alias("_y"), F.col(features).cast("array<double>").alias("_x")))
    moments = _moments(data)
    classes = {r: np.flatnonzero(m[0]) for r, m in moments.items()}
    states = {r: KINDS[kind](classes[r], len(m[1]) + 1) for r, m in moments.items()}
    sums_of = KINDS[kind].sums
    for _ in range(STEPS):
        now = {r: s.w for r, s in states.items() if not s.done}
        if not now:
            break
        shared = spark.sparkContext.broadcast((now, classes, moments))

        def add(batches, shared=shared):
            now, classes, moments = shared.value
            sums = {}
            for b in batches:
                x, label = _rows_of(b), np.asarray(b.column(1))
                for r, at in _by_run(np.asarray(b.column(0))):
                    if r not in now:
                        continue
                    _, mean, deviation = moments[r]
                    z = np.hstack([(x[at] - mean) / deviation, np.ones((len(at), 1))])
                    sums[r] = sums_of(z, np.searchsorted(classes[r], label[at]), now[r]) + sums.get(r, 0.0)
            yield _sliced(sums)

        total = _sums(data.mapInArrow(add, PARTS))
        for r in now:
            states[r].take(total[r], moments[r][0].sum())
    return [(runs[r], classes[r], moments[r][1], moments[r][2], states[r].w) for r in sorted(moments)]


def predict(models: list, rows: DataFrame, keys, kind="softmax", features="features", name="p") -> DataFrame:
    """``rows`` with a five-class probability row; null where the run has no model or the vector is null."""
    keys = list(keys)
    known = {m[0]: m[1:] for m in models}
    shared = rows.sparkSession.sparkContext.broadcast(known)
    out = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at_keys, at_x = [rows.columns.index(k) for k in keys], rows.columns.index(features)

    def run(batches):
        known = shared.value
        for b in batches:
            ident = list(zip(*[b.column(i).to_pylist() for i in at_keys])) if at_keys else [()] * b.num_rows
            empty = b.column(at_x).is_null().to_pylist()
            p = [None] * b.num_rows
            groups = {}
            for i, k in enumerate(ident):
                if k in known and not empty[i]:
                    groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                classes, mean, deviation, w = known[k]
                column = b.column(at_x).take(pa.array(at)).cast(pa.list_(pa.float64()))
                x = (np.asarray(column.flatten()).reshape(len(at), -1) - mean) / deviation
                z = np.full((len(at), N_CLASSES), -np.inf if kind == "softmax" else MISSING)
                z[:, classes] = np.hstack([x, np.ones((len(at), 1))]) @ w.T
                for i, row in zip(at, _softmax(z)):
                    p[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], [*b.schema.names, name])

    return rows.mapInArrow(run, out)
