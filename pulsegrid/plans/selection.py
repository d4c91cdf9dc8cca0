"""Parameter-grid evaluation and best-candidate rules.

A task evaluates every candidate on its rows in Arrow batches and keeps only counts per
(run, candidate, y, predicted class). Rows are neither multiplied by the grid nor
shuffled: what leaves a task is at most runs x candidates x 25 counts.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P
from pulsegrid.operators.metrics import absent_share, class_counts, metric_row, widen_counts
from pulsegrid.operators.ranking import best_row
from pulsegrid.plans.decoders import prior_bias
from pulsegrid.schema import SHIFT_DATASET, SHIFT_DECODER

# Fusion weights of the adapter grid.
ALPHAS = [0.20, 0.35, 0.50, 0.65, 0.80]
# The boundary-aware grid.
BOUNDARY_ALPHAS = [0.25, 0.50, 0.75]
BOUNDARY_STRENGTHS = [0.0, 0.25, 0.50, 0.75, 1.0]
BOUNDARY_TAUS = [0.05, 0.10, 0.20]
BOUNDARY_ETAS = [0.05, 0.10, 0.20]
# Class multipliers of the wide and the S-focused grid, and the default point.
MULTIPLIERS = {
    "wide": ([0.65, 0.75, 0.85, 0.95], [1.5, 2.0, 2.5, 3.0, 3.5],
             [0.75, 0.85, 0.95, 1.05], [1.2, 1.6, 2.0, 2.4, 3.0]),
    "s_focus": ([0.75, 0.85, 0.95, 1.05], [2.0, 2.5, 3.0, 3.5, 4.0],
                [0.75, 0.85, 0.95, 1.05], [0.3, 0.5, 1.0]),
}
DEFAULT_MULTIPLIER = (0.85, 2.5, 0.95, 2.0)


def predicted_cells(predict):
    """Counts (candidates x 25 confusion cells) of the classes that ``predict`` maps input arrays to, (rows, candidates)."""
    def count(labels, *inputs):
        preds = predict(*inputs)
        n_cand = preds.shape[1]
        code = np.arange(n_cand) * 25 + labels[:, None] * 5 + preds
        return np.bincount(code.ravel(), minlength=n_cand * 25).reshape(n_cand, 25)
    return count


def candidate_confusions(rows: DataFrame, keys, inputs, cells, y="y") -> DataFrame:
    """Confusion cells per (keys, cand); ``cells`` maps labels and input arrays to counts (candidates x 25)."""
    keys = list(keys)
    data = rows.select(*keys, F.col(y).cast("int").alias("_y"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)])
    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "cand int", "_y int", "_p int", "_n long"])
    width = len(inputs)

    def count(batches):
        totals = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                counts = cells(part["_y"].to_numpy(), *[np.stack(part[f"_x{i}"].to_numpy()) for i in range(width)]).ravel()
                totals[key] = totals[key] + counts if key in totals else counts
        for key, counts in totals.items():
            at = np.flatnonzero(counts)
            out = {k: [v] * len(at) for k, v in zip(keys, key)}
            yield pd.DataFrame({**out, "cand": at // 25, "_y": at % 25 // 5, "_p": at % 5, "_n": counts[at]})

    small = data.mapInPandas(count, schema)
    return widen_counts(small, [*keys, "cand"], "_y", "_p", "_n")


def _policy_arrays(decoders):
    """Flat decoder numbers: six powers, then six times five multipliers."""
    return F.concat(F.transform(decoders, lambda d: d["power"]), F.flatten(F.transform(decoders, lambda d: d["multiplier"])))


def _decode_all(p, policies):
    """Predictions of the six decoders for rows above the clip floor (any trailing layout).

    Scaling a row does not move its largest entry, so no renormalisation is needed.
    """
    powers, mult = policies[0, :6], policies[0, 6:].reshape(6, 5)
    return np.stack([(p ** w * m).argmax(axis=-1) for w, m in zip(powers, mult)], axis=-1)


def _np_softmax(s):
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _predict_adapter(backbone, evidence, policies):
    lb, le = (np.log(np.clip(p, 1e-8, 1.0)) for p in (backbone, evidence))
    return np.concatenate(
        [_decode_all(_np_softmax((1.0 - a) * lb + a * le), policies) for a in ALPHAS], axis=1)


def _predict_decoders(p, policies):
    p = np.clip(p, 1e-12, None)
    return _decode_all(p / p.sum(axis=1, keepdims=True), policies)


def _predict_boundary(backbone, evidence, biases):
    lb, le = (np.log(np.clip(p, 1e-8, 1.0)) for p in (backbone, evidence))
    centred = le - le.mean(axis=1, keepdims=True)
    preds = []
    for a in BOUNDARY_ALPHAS:
        for bias in biases[0].reshape(len(BOUNDARY_STRENGTHS), 5):
            scores = (1.0 - a) * lb + a * le + bias
            preds.append(scores.argmax(axis=1))
            top = np.partition(scores, 3, axis=1)
            margin = top[:, 4] - top[:, 3]
            for tau in BOUNDARY_TAUS:
                closeness = np.exp(-margin / tau)[:, None] * centred
                preds += [(scores + eta * closeness).argmax(axis=1) for eta in BOUNDARY_ETAS]
    return np.stack(preds, axis=1)


def _with_side(rows, side, keys):
    small = F.broadcast(side)  # one row of fixed width per run key
    return rows.join(small, list(keys)) if keys else rows.crossJoin(small)


def adapter_grid(val: DataFrame, policies: DataFrame, keys=(), backbone="p_backbone", evidence="p_evidence",
                 y="y") -> DataFrame:
    """30 candidates (alpha x decoder) with metrics and the absent-class penalty.

    ``val`` holds both probability rows, ``policies`` the packed decoders of the fit rows.
    """
    keys = list(keys)
    rows = _with_side(val, policies, keys).withColumn("_pol", _policy_arrays("decoders"))
    cells = candidate_confusions(rows, keys, [backbone, evidence, "_pol"], predicted_cells(_predict_adapter), y)
    scored = metric_row(cells, [*keys, "cand"])
    scored = scored.withColumn("penalty", absent_share())
    named = _with_side(scored, policies, keys)
    d = F.get("decoders", (F.col("cand") % 6).cast("int"))
    alphas = F.array(*[F.lit(a) for a in ALPHAS])
    return named.select(
        *keys, "cand", F.get(alphas, F.floor(F.col("cand") / 6).cast("int")).alias("alpha"),
        d["decoder"].alias("decoder"), d["power"].alias("power"), d["multiplier"].alias("multiplier"),
        "macro_f1_4", "accuracy", "F1_S", "F1_F", "penalty",
        (F.col("macro_f1_4") - 0.25 * F.col("penalty")).alias("key1"),
        (F.col("F1_S") + F.col("F1_F")).alias("key2"),
        *[f"predicted_{c}" for c in "NSVFQ"], *[f"support_{c}" for c in "NSVFQ"],
    )


def select_adapter(grid: DataFrame, policies: DataFrame, keys=(), dataset="dataset") -> DataFrame:
    """Best candidate per key; the shifted dataset keeps its alpha but takes the fixed decoder."""
    keys = list(keys)
    best = best_row(grid, keys, ["key1", "key2", "accuracy"], "cand",
                    ["alpha", "decoder", "power", "multiplier", "macro_f1_4", "accuracy", "F1_S", "F1_F"])
    if dataset not in keys:
        return best
    out = _with_side(best, policies, keys)
    fixed = F.filter("decoders", lambda d: d["decoder"] == SHIFT_DECODER)[0]
    shift = F.col(dataset) == SHIFT_DATASET
    for c in ("decoder", "power", "multiplier"):
        out = out.withColumn(c, F.when(shift, fixed[c]).otherwise(F.col(c)))
    return out.drop("decoders")


def top_candidates(grid: DataFrame, keys=(), k=8) -> DataFrame:
    """The k best candidates per key as one array of structs, best first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("key1"), F.desc("key2"), F.desc("accuracy"), "cand")
    best = grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    item = F.struct(
        "_r", "alpha", "decoder", "power", "multiplier", F.col("macro_f1_4").alias("val_macro_f1_4"),
        F.col("accuracy").alias("val_accuracy"), F.col("F1_S").alias("val_F1_S"), F.col("F1_F").alias("val_F1_F"))
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c")).select(
        *keys, F.transform("_c", lambda c: c.dropFields("_r")).alias("candidates"))


def apply_adapter(rows: DataFrame, selected: DataFrame, keys=(), backbone="p_backbone",
                  evidence="p_evidence") -> DataFrame:
    """Adapted scores and prediction for every row under the selected policy of its run."""
    side = selected.select(*keys, "alpha", "power", "multiplier")
    out = _with_side(rows, side, keys)
    out = out.withColumn("_f", P.fuse(F.col(backbone), F.col(evidence), F.col("alpha")))
    out = out.withColumn("_s", P.decision_scores(F.col("_f"), F.col("power"), F.col("multiplier")))
    return out.select(
        *rows.columns, F.col("_f").alias("p_fused"), P.normalise(F.col("_s")).alias("p_adapted"),
        A.argmax(F.col("_s")).alias("pred"))


def decoder_candidates(val: DataFrame, policies: DataFrame, keys=(), p="p", y="y") -> DataFrame:
    """The six decoders scored on validation rows."""
    keys = list(keys)
    rows = _with_side(val, policies, keys).withColumn("_pol", _policy_arrays("decoders"))
    cells = candidate_confusions(rows, keys, [p, "_pol"], predicted_cells(_predict_decoders), y)
    scored = metric_row(cells, [*keys, "cand"])
    scored = scored.withColumn("penalty", absent_share())
    names = F.array(*[F.lit(n) for n in ("evidence_argmax", "clinical_default", "stable_prior",
                                         "s_recovery", "f_recovery", "mild_prior")])
    return scored.select(
        *keys, "cand", F.get(names, F.col("cand")).alias("decoder"), "macro_f1_4", "accuracy",
        "F1_S", "F1_F", "support_F",
        (F.col("macro_f1_4") - 0.25 * F.col("penalty")).alias("key1"),
        (F.col("F1_S") + F.col("F1_F")).alias("key2"))


def guarded_decoder(cands: DataFrame, keys=(), dataset=None) -> DataFrame:
    """Best decoder, unless the risk guard sends the choice back to the plain evidence.

    Rejected when the macro gain is under .015, accuracy falls by more than .004, F1_S falls
    by more than .08, or F1_F gains on fewer than ten validation F rows. The rejected
    candidate is kept in ``rejected``. The shifted dataset always takes the fixed decoder.
    """
    fields = F.struct("decoder", "macro_f1_4", "accuracy", "F1_S", "F1_F", "support_F")
    picked = cands.groupBy(*keys).agg(
        F.max_by(fields, F.struct("key1", "key2", "accuracy", -F.col("cand"))).alias("b"),
        F.max(F.when(F.col("decoder") == "evidence_argmax", fields)).alias("a"))
    gain = F.col("b.macro_f1_4") - F.col("a.macro_f1_4")
    acc_drop = F.col("a.accuracy") - F.col("b.accuracy")
    s_drop = F.col("a.F1_S") - F.col("b.F1_S")
    f_gain = F.col("b.F1_F") - F.col("a.F1_F")
    refuse = (F.col("b.decoder") != "evidence_argmax") & (
        (gain < 0.015) | (acc_drop > 0.004) | (s_drop > 0.08) | ((f_gain > 0) & (F.col("b.support_F") < 10)))
    chosen = F.when(refuse, F.lit("evidence_argmax")).otherwise(F.col("b.decoder"))
    if dataset:
        chosen = F.when(F.col(dataset) == SHIFT_DATASET, F.lit(SHIFT_DECODER)).otherwise(chosen)
    return picked.select(
        *keys, chosen.alias("decoder"), F.col("b.decoder").alias("candidate"), refuse.alias("rejected"),
        gain.alias("gain_macro_f1_4"), acc_drop.alias("accuracy_drop"), s_drop.alias("F1_S_drop"),
        F.col("b.support_F").alias("val_F_count"), f_gain.alias("F1_F_gain"))


def boundary_grid(val: DataFrame, fit: DataFrame, keys=(), backbone="p_backbone", evidence="p_evidence",
                  y="y") -> DataFrame:
    """Score all 150 (alpha, strength, tau, eta) settings; tau = eta = 0 comes first in each ten.

    Per (alpha, strength) the fused scores, margin and centred evidence are computed once;
    the nine (tau, eta) settings only rescale the push along the evidence.
    """
    keys = list(keys)
    counts = class_counts(fit, keys, y)
    biases = F.flatten(F.array(*[prior_bias(s) for s in BOUNDARY_STRENGTHS]))
    rows = _with_side(val, counts.select(*keys, biases.alias("_bias")), keys)
    cells = candidate_confusions(rows, keys, [backbone, evidence, "_bias"], predicted_cells(_predict_boundary), y)
    scored = metric_row(cells, [*keys, "cand"])
    c, inner = F.col("cand"), F.col("cand") % 10 - 1

    def pick(values, at):
        return F.get(F.array(*[F.lit(v) for v in values]), F.floor(at).cast("int"))

    return scored.select(
        *keys, "cand",
        pick(BOUNDARY_ALPHAS, c / 50).alias("alpha"),
        pick(BOUNDARY_STRENGTHS, c % 50 / 10).alias("prior_strength"),
        F.when(inner < 0, 0.0).otherwise(pick(BOUNDARY_TAUS, inner / 3)).alias("boundary_tau"),
        F.when(inner < 0, 0.0).otherwise(pick(BOUNDARY_ETAS, inner % 3)).alias("boundary_eta"),
        "macro_f1_4", "accuracy", "F1_S", "F1_F", (F.col("F1_S") + F.col("F1_F")).alias("tail"))


def select_boundary(grid: DataFrame, keys=()) -> DataFrame:
    return best_row(grid, list(keys), ["macro_f1_4", "accuracy", "tail"], "cand",
                    ["alpha", "prior_strength", "boundary_tau", "boundary_eta", "macro_f1_4", "accuracy", "tail"])


def multiplier_points(kind="wide"):
    n, s, v, f = MULTIPLIERS[kind]
    return [(a, b, c, d) for a in n for b in s for c in v for d in f]


def swept_cells(labels, x, axes):
    """Counts (grid points x 25) of the largest of x times (n, s, v, f, 1) over the grid of four axes, f fastest; ties to the lower class.

    With the first three multipliers fixed, a row has one best class apart from F, and one breakpoint on the ascending f axis from which
    on F beats it. The row adds one to that class at the start of the axis and moves to F at the breakpoint; running sums along
    the axis give all points. Entries of ``x`` are not negative.
    """
    n, s, v, f = axes
    order = np.argsort(f, kind="stable")
    steps, rivals = f[order], np.array([0, 1, 2, 4])
    out = np.zeros((len(n), len(s), len(v), 5, 5, len(f) + 1), np.int64)
    tail = x[:, 3, None] * steps
    for i, j, k in np.ndindex(out.shape[:3]):
        others = x[:, rivals] * np.array([n[i], s[j], v[k], 1.0])
        best = others.argmax(axis=1)
        top = others[np.arange(len(x)), best][:, None]
        wins = np.where(best[:, None] == 3, tail >= top, tail > top)
        turn = len(f) - wins.sum(axis=1)
        rival = rivals[best]
        np.add.at(out[i, j, k], (labels, rival, 0), 1)
        np.add.at(out[i, j, k], (labels, rival, turn), -1)
        np.add.at(out[i, j, k], (labels, 3, turn), 1)
    points = out.cumsum(axis=-1)[..., :-1]
    back = np.empty_like(points)
    back[..., order] = points
    return np.moveaxis(back, -1, 3).reshape(-1, 25)


def multiplier_grid(rows: DataFrame, keys=(), kind="wide", p="p", y="y") -> DataFrame:
    """Default point (cand 0) and every multiplier of the grid, with metrics and supports."""
    keys = list(keys)
    fixed, grid = np.array([*DEFAULT_MULTIPLIER, 1.0]), [np.array(v, float) for v in MULTIPLIERS[kind]]
    at_default = predicted_cells(lambda x: (x * fixed).argmax(axis=1)[:, None])

    def cells(labels, x):
        return np.concatenate([at_default(labels, x), swept_cells(labels, x, grid)])

    scored = metric_row(candidate_confusions(rows, keys, [p], cells, y), [*keys, "cand"])
    axes, step, at = [], 1, F.col("cand") - 1
    for values, default in reversed(list(zip(MULTIPLIERS[kind], DEFAULT_MULTIPLIER))):
        spot = (F.floor(at / step) % len(values)).cast("int")
        picked = F.get(F.array(*[F.lit(float(v)) for v in values]), F.greatest(spot, F.lit(0)))
        axes.insert(0, F.when(F.col("cand") == 0, F.lit(float(default))).otherwise(picked))
        step *= len(values)
    mode = F.when(F.col("cand") == 0, "default_step12_mult").otherwise("target_calibrated")
    return scored.select(
        *keys, "cand", mode.alias("mode"),
        *[m.alias(n) for m, n in zip(axes, ("n_mul", "s_mul", "v_mul", "f_mul"))],
        *[c for c in scored.columns if c not in (*keys, "cand")])


def kept_multipliers(grid: DataFrame, keys=(), metric="macro_f1_4", threshold=0.50) -> DataFrame:
    """Default row, calibrated rows at or above the threshold, and the best row; no repeats."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.desc("accuracy"), "cand")
    ranked = grid.withColumn("_r", F.row_number().over(w))
    keep = (F.col("cand") == 0) | (F.col(metric) >= threshold) | (F.col("_r") == 1)
    return ranked.where(keep).withColumn("is_best", F.col("_r") == 1).drop("_r")
