"""Multiclass histogram boosting: every run of a grid is boosted by itself, all runs in one job.

The rows of a run are coded once into at most BINS quantile bins a feature. Every round grows one tree a class on the gradient and
Hessian of the softmax loss, best leaf first, up to LEAVES leaves: a leaf's histogram holds gradient, Hessian and rows by
(feature, bin); of two new leaves only the smaller one is counted, the other is its parent's histogram minus that. The loss on a
held-out tenth of the rows, drawn by hash, ends the rounds once none of the last PATIENCE has lowered it.

A run is fitted on all of its rows, in one task: it streams them into one matrix (in a file of its temporary folder beyond
``forests.IN_MEMORY`` bytes) and boosts over two coded copies of a byte a value. That is linear in the rows of a run, with no bound, and the rounds
follow each other in that one task.
Scoring streams the target rows of a run past its trees. Rows without a class or with a null vector are not fitted; null vectors and
runs without trees score null. One class in a run gives that class probability one.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.functions import hashing
from pulsegrid.plans.forests import _arrive, _array, _linked, _matrix, row_text
from pulsegrid.schema import N_CLASSES
from pulsegrid.session import pin, unioned_lists

# Rounds, learning rate, leaves, penalty, smallest leaf, held-out share and patience of the source material.
ROUNDS, RATE, LEAVES, PENALTY, MIN_ROWS, HELD_OUT, PATIENCE = 260, 0.05, 31, 0.05, 20, 0.1, 10
#: Bins of a feature, smallest Hessian of a leaf, fall of the held-out loss that counts, values of a leaf that are counted at once.
BINS, MIN_HESSIAN, FALL, CELLS = 255, 1e-3, 1e-7, 1 << 18


def edges_of(x, rows=slice(None)):
    """Cuts of every feature over ``rows``: between all values where these are few, else quantiles."""
    out = []
    for f in range(x.shape[1]):
        v = x[rows, f]
        values = np.unique(v)
        if len(values) > BINS:
            values = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))
            out.append(values)
        else:
            middle = (values[:-1] + values[1:]) / 2
            out.append(np.where(middle < values[1:], middle, values[:-1]))
    return out


def codes_of(x, edges, rows=slice(None)):
    """Bin of every value of ``rows``: the number of cuts below it, so that values up to cut b are in bins 0 to b."""
    out = np.zeros((len(x[rows, 0]), len(edges)), np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[rows, f], side="left")
    return out


def _histogram(cells, size, g, h, rows):
    """(3, features * bins): gradient, Hessian and rows."""
    at = cells[rows]
    width = at.shape[1]
    flat = at.ravel()
    return np.stack([np.bincount(flat, np.repeat(g[rows], width), size), np.bincount(flat, np.repeat(h[rows], width), size),
                     np.bincount(flat, minlength=size)])


def _counted(columns, codes, bins, g, h, rows):
    """_histogram of ``rows`` of ``codes``; many rows feature by feature (``columns``: the codes by feature), which adds in the same order."""
    width = len(columns)
    if len(rows) * width <= CELLS:
        cells = codes[rows] + np.arange(width) * bins
        return _histogram(cells, width * bins, g[rows], h[rows], slice(None))
    mine_g, mine_h = g[rows], h[rows]
    out = np.zeros((3, width, bins))
    for f, column in enumerate(columns):
        at = column[rows]
        out[:, f] = np.bincount(at, mine_g, bins), np.bincount(at, mine_h, bins), np.bincount(at, minlength=bins)
    return out.reshape(3, -1)


def best_split(histogram, bins):
    """(gain, feature, bin) of the best cut of a leaf, ties to the lower feature and bin; gain 0 if none."""
    g, h, n = (v.reshape(-1, bins).cumsum(1) for v in histogram)
    total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
    right_g, right_h, right_n = total_g - g, total_h - h, total_n - n
    gain = g ** 2 / (h + PENALTY) + right_g ** 2 / (right_h + PENALTY) - total_g ** 2 / (total_h + PENALTY)
    ok = (n >= MIN_ROWS) & (right_n >= MIN_ROWS) & (h >= MIN_HESSIAN) & (right_h >= MIN_HESSIAN)
    gain = np.where(ok, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // bins, at % bins


def grow_tree(codes, g, h, bins, leaves=LEAVES, columns=None):
    """(feature, bin, left, right, value): nodes of one tree over coded rows, best leaf first; a feature of -1 marks a leaf."""
    columns = np.ascontiguousarray(codes.T) if columns is None else columns
    feature, cut, left, right, value = [], [], [], [], []

    def leaf(rows, histogram):
        feature.append(-1)
        cut.append(0)
        left.append(-1)
        right.append(-1)
        value.append(-RATE * g[rows].sum() / (h[rows].sum() + PENALTY))
        split = best_split(histogram, bins) if len(rows) >= 2 * MIN_ROWS else (0.0, 0, 0)
        return [len(feature) - 1, rows, histogram, split]

    rows = np.arange(len(g))
    open_ = [leaf(rows, _counted(columns, codes, bins, g, h, rows))]
    while len(open_) and (len(feature) + 1) // 2 < leaves:
        best = max(open_, key=lambda o: (o[3][0], -o[0]))
        open_.remove(best)
        node, rows, histogram, (gain, f, b) = best
        if gain <= 0:
            break
        goes = columns[f][rows] <= b
        parts = [rows[goes], rows[~goes]]
        small = int(len(parts[1]) < len(parts[0]))
        counted = _counted(columns, codes, bins, g, h, parts[small])
        both = [counted, histogram - counted] if small == 0 else [histogram - counted, counted]
        feature[node], cut[node] = f, b
        kids = [leaf(p, t) for p, t in zip(parts, both)]
        left[node], right[node] = kids[0][0], kids[1][0]
        open_ += [k for k in kids if k[3][0] > 0]
    return tuple(np.array(v) for v in (feature, cut, left, right, value))


def _values(tree, codes):
    feature, cut, left, right, value = tree
    return value[_arrive(codes, *_linked(feature, left, right), cut)]


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(z, y):
    top = z.max(1)
    return float((np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]).mean())


def boost(x, y, held, rounds=ROUNDS):
    """(classes, start scores, edges, trees of every round, losses on the fitted rows and the held-out ones)."""
    classes, label = np.unique(y, return_inverse=True)
    k = len(classes)
    start = np.log(np.bincount(label, minlength=k) / len(label))
    if k < 2:
        return classes, start, [], [], []
    held = held if 0 < held.sum() and len(np.unique(label[~held])) == k else np.zeros(len(y), bool)
    edges = edges_of(x, np.flatnonzero(~held))
    bins = max(len(e) for e in edges) + 1
    codes, other = codes_of(x, edges, np.flatnonzero(~held)), codes_of(x, edges, np.flatnonzero(held))
    columns = np.ascontiguousarray(codes.T)
    fit, rest = label[~held], label[held]
    z, z_rest = np.tile(start, (len(fit), 1)), np.tile(start, (len(rest), 1))
    grown, losses = [], [(_loss(z, fit), _loss(z_rest, rest) if len(rest) else 0.0)]
    hit = np.eye(k)[fit]
    for _ in range(rounds):
        p = _softmax(z)
        grown.append([grow_tree(codes, p[:, c] - hit[:, c], p[:, c] * (1 - p[:, c]), bins, columns=columns) for c in range(k)])
        for c, tree in enumerate(grown[-1]):
            z[:, c] += _values(tree, codes)
            z_rest[:, c] += _values(tree, other)
        losses.append((_loss(z, fit), _loss(z_rest, rest) if len(rest) else 0.0))
        recent = [v for _, v in losses[-PATIENCE - 1:]]
        if len(rest) and len(losses) > PATIENCE and min(recent[1:]) > recent[0] - FALL:
            break
    return classes, start, edges, grown, losses


MODEL = [("classes", T.ArrayType(T.IntegerType())), ("start", T.ArrayType(T.DoubleType())), ("edges", T.ArrayType(T.ArrayType(T.DoubleType()))),
         ("feature", T.ArrayType(T.ArrayType(T.IntegerType()))), ("cut", T.ArrayType(T.ArrayType(T.IntegerType()))), ("left", T.ArrayType(T.ArrayType(T.IntegerType()))),
         ("right", T.ArrayType(T.ArrayType(T.IntegerType()))), ("value", T.ArrayType(T.ArrayType(T.DoubleType()))), ("losses", T.ArrayType(T.ArrayType(T.DoubleType())))]


def grow(fit: DataFrame, keys, row_id="beat_id", seed="seed", features="features", y="y", size=1.0) -> DataFrame:
    """One row per run: cuts, trees (class by class within a round) as parallel arrays, and the losses after every round."""
    keys = list(keys)
    rounds = max(1, round(ROUNDS * size))
    rows = fit.select(*keys, F.col(seed).cast("long").alias("_seed"), row_text(fit, row_id).alias("_id"), F.col(y).cast("int").alias("_y"),
                      F.col(features).cast("array<double>").alias("_x")).where("_y is not null and _x is not null")
    rows = rows.withColumn("_held", F.coalesce(hashing.uniform("held", F.col("_seed"), F.col("_id")) < HELD_OUT, F.lit(False)))
    runs = [tuple(r) for r in rows.groupBy(*keys).agg(F.count(F.lit(1))).collect()]  # the run grid
    schema = T.StructType([fit.schema[k] for k in keys] + [T.StructField(c, t) for c, t in MODEL])
    names = T.StructType([*schema.fields[:len(keys)], T.StructField("_run", T.IntegerType())])
    numbered = fit.sparkSession.createDataFrame([(*r[:-1], i) for i, r in enumerate(runs)], names)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(numbered[k]) for k in keys])
    dealt = rows.join(F.broadcast(numbered), same).select("_run", "_id", "_y", "_held", "_x").repartitionById(max(1, len(runs)), "_run")

    def run(batches):
        own, x, at, parts = None, None, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            values = _matrix(b.column(4))
            if x is None:
                own = runs[b.column(0)[0].as_py()]
                x = _array((own[-1], values.shape[1]), np.float64)
            x[at:at + b.num_rows] = values
            at += b.num_rows
            parts.append((b.column(1).to_numpy(zero_copy_only=False).astype(str), b.column(2).to_numpy().copy(), b.column(3).to_numpy(zero_copy_only=False).astype(bool)))
        if x is None:
            return
        ids, label, held = (np.concatenate(v) for v in zip(*parts))
        order = np.lexsort((*x.T[:2], ids))
        for f in range(x.shape[1]):
            x[:, f] = x[order, f]
        classes, start, edges, grown, losses = boost(x, label[order], held[order], rounds)
        trees = [t for r in grown for t in r]
        values = [classes.tolist(), start.tolist(), [e.tolist() for e in edges], *[[t[i].tolist() for t in trees] for i in range(5)], [list(v) for v in losses]]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*own[:-1], *values]))], types)

    types = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


def score(models: DataFrame, rows: DataFrame, keys, features="features", name="p") -> DataFrame:
    """``rows`` with a five-class probability row from the trees of their run."""
    keys = list(keys)
    left = rows.select("*", F.col(features).cast("array<double>").alias("_x"))
    asked = left.select(F.struct(*rows.columns).alias("_row"), *keys, "_x", F.lit(True).alias("_asked"),
                        F.expr("cast(pmod(xxhash64(_x), 16) as int)").alias("_slice"))
    known = models.select(*keys, *[c for c, _ in MODEL[:-1]], F.lit(False).alias("_asked"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_slice"))
    both = unioned_lists(known, asked).select(*keys, "_slice", "_asked", "_x", *[c for c, _ in MODEL[:-1]], "_row")
    lead = len(keys)
    out = T.StructType([T.StructField("_row", asked.schema["_row"].dataType), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        own, model = None, None
        for b in batches:
            ident = list(zip(*[b.column(i).to_pylist() for i in range(lead + 1)]))
            is_row = b.column(lead + 1).to_pylist()
            cuts = [0, *(i for i in range(1, b.num_rows) if ident[i] != ident[i - 1] or is_row[i] != is_row[i - 1]), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if ident[lo] != own:
                    own, model = ident[lo], None
                part = b.slice(lo, hi - lo)
                if not is_row[lo]:
                    model = unpacked([part.column(lead + 3 + i)[0].as_py() for i in range(len(MODEL) - 1)])
                    continue
                yield pa.RecordBatch.from_arrays([part.column(part.num_columns - 1), pa.array(probabilities(model, part.column(lead + 2)), pa.list_(pa.float64()))],
                                                 ["_row", name])

    met = both.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "_asked").mapInArrow(run, out)
    return met.select("_row.*", name)


def unpacked(model):
    """(classes, start, edges, trees) as arrays."""
    classes, start, edges, *trees = model
    return classes, np.array(start), [np.array(e) for e in edges], [tuple(np.array(v) for v in t) for t in zip(*trees)]


def probabilities(model, vectors):
    """Probability rows (None where there is no model or vector) of an Arrow list column; ``model`` as ``unpacked`` gives it."""
    out = [None] * len(vectors)
    some = np.flatnonzero(~np.asarray(vectors.is_null()))
    if model is None or not len(some):
        return out
    classes, start, edges, trees = model
    x = np.asarray(vectors.take(pa.array(some)).flatten()).reshape(len(some), -1)
    z = np.tile(start, (len(x), 1))
    if trees:
        codes = codes_of(x, edges)
        for i, tree in enumerate(trees):
            z[:, i % len(classes)] += _values(tree, codes)
    p = np.zeros((len(x), N_CLASSES))
    p[:, classes] = _softmax(z)
    for i, row in zip(some, p):
        out[i] = row
    return out


def fit_predict(fit, target, keys, row_id="beat_id", seed="seed", features="features", y="y", out="p", size=1.0) -> DataFrame:
    return score(pin(grow(fit, keys, row_id, seed, features, y, size)), target, keys, features, out)
