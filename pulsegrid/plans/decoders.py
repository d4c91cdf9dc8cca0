"""Decoder policies, class weights and prior bias built from class counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators.metrics import class_counts, prior_ratio
from pulsegrid.schema import CLASS_NAMES, N_CLASSES

# Decoder -> (power, per class (exponent of the prevalence ratio, low, high)).
# An exponent of None takes the low value as a constant.
DECODERS = {
    "evidence_argmax": (1.00, [(None, 1.00, 1.00), (None, 1.0, 1.0), (None, 1.0, 1.0), (None, 1.0, 1.0)]),
    "clinical_default": (1.00, [(None, 0.85, 0.85), (0.23, 1.0, 2.60), (-0.02, 0.90, 1.05), (0.15, 1.0, 2.20)]),
    "stable_prior": (0.90, [(None, 1.00, 1.00), (0.25, 1.0, 4.00), (0.03, 1.0, 1.50), (0.20, 1.0, 4.00)]),
    "s_recovery": (0.95, [(None, 0.90, 0.90), (0.28, 1.0, 4.50), (None, 1.00, 1.00), (0.08, 1.0, 1.60)]),
    "f_recovery": (0.95, [(None, 0.90, 0.90), (0.08, 1.0, 1.60), (None, 0.98, 0.98), (0.22, 1.0, 4.00)]),
    "mild_prior": (0.95, [(None, 0.95, 0.95), (0.18, 1.0, 2.50), (None, 1.00, 1.00), (0.12, 1.0, 2.20)]),
}
RATIONALE = {
    "evidence_argmax": "take the evidence as it is",
    "clinical_default": "damp N, raise S and F moderately",
    "stable_prior": "long-tail prior for missed S and F",
    "s_recovery": "recover missed S",
    "f_recovery": "recover F where training support allows",
    "mild_prior": "mild prevalence correction",
}

# Decision multiplier mode -> per class (exponent, cap); N takes the constant.
MULTIPLIER_MODES = {
    "none": (1.0, [(0.0, 1.0), (0.0, 1.0), (0.0, 1.0)]),
    "stable_prior": (1.0, [(0.25, 4.0), (0.03, 1.5), (0.20, 4.0)]),
    "mild_prior": (1.0, [(0.20, 3.0), (0.02, 1.3), (0.15, 3.0)]),
    "tail_prior": (0.95, [(0.28, 4.5), (0.05, 1.7), (0.25, 5.0)]),
}

# Constant class weights per mode or audit profile.
CONSTANT_WEIGHTS = {
    "none": [1.0, 1.0, 1.0, 1.0, 1.0],
    "no_cost": [1.0, 1.0, 1.0, 1.0, 1.0],
    "legacy_cost": [1.0, 3.0, 1.5, 12.0, 1.0],
    "default_cost": [1.0, 3.0, 1.5, 12.0, 1.0],
    "moderate_tail": [1.0, 2.0, 1.25, 6.0, 1.0],
    "strong_tail": [0.95, 4.0, 1.5, 16.0, 1.0],
}
# N constant, then (exponent, cap) of the prevalence ratio for S, V, F.
RATIO_WEIGHTS = {
    "smooth_cost": (1.0, [(0.22, 4.0), (0.08, 1.8), (0.28, 12.0)]),
    "tail_cost": (0.95, [(0.28, 5.0), (0.10, 2.0), (0.35, 16.0)]),
}
WEIGHT_MODES = [*CONSTANT_WEIGHTS, *RATIO_WEIGHTS, "balanced", "balanced_sqrt", "balanced_log"]
COST_PROFILES = ["default_cost", "no_cost", "balanced", "moderate_tail", "strong_tail"]


def _capped(ratio: str, exponent, lo, hi) -> str:
    if exponent is None:
        return f"{float(lo)}D"
    return f"least(greatest(pow({ratio}, {float(exponent)}D), {float(lo)}D), {float(hi)}D)"


def decoder_structs(ratio: str) -> Column:
    """The six policies, in fixed order, as an array of structs over a ratio array column."""
    items = []
    for i, (name, (power, spec)) in enumerate(DECODERS.items()):
        values = ", ".join(_capped(f"{ratio}[{c}]", *three) for c, three in enumerate(spec))
        items.append(
            f"named_struct('decoder', '{name}', 'ord', {i}, 'power', {float(power)}D, "
            f"'multiplier', array({values}, 1.0D), 'rationale', '{RATIONALE[name]}')")
    return F.expr(f"array({', '.join(items)})")


def decoder_table(fit: DataFrame, keys=(), y="y") -> DataFrame:
    """(keys, decoder, ord, power, multiplier, rationale) from the class counts of the fit rows."""
    counts = class_counts(fit, keys, y)
    rows = counts.select(*keys, prior_ratio().alias("_r"))
    return rows.select(*keys, F.explode(decoder_structs("_r")).alias("d")).select(*keys, "d.*")


def packed_decoders(fit: DataFrame, keys=(), y="y") -> DataFrame:
    """One row per key with the policies in one array, ready to broadcast."""
    counts = class_counts(fit, keys, y)
    return counts.select(*keys, prior_ratio().alias("_r")).select(
        *keys, decoder_structs("_r").alias("decoders"))


def decision_multiplier(ratio: Column, mode: str) -> Column:
    first, rest = MULTIPLIER_MODES[mode]
    if mode == "none":
        return F.array(*[F.lit(1.0)] * N_CLASSES)
    tail = [F.least(F.pow(ratio[c + 1], F.lit(e)), F.lit(cap)) for c, (e, cap) in enumerate(rest)]
    return F.array(F.lit(first), *tail, F.lit(1.0))


def class_weights(mode: str, prefix="count_") -> Column:
    """Weight array of a mode over count_N..count_Q columns."""
    if mode in CONSTANT_WEIGHTS:
        return F.array(*[F.lit(w) for w in CONSTANT_WEIGHTS[mode]])
    if mode in RATIO_WEIGHTS:
        ratio, (first, rest) = prior_ratio(prefix), RATIO_WEIGHTS[mode]
        tail = [F.least(F.pow(ratio[c + 1], F.lit(e)), F.lit(cap)) for c, (e, cap) in enumerate(rest)]
        return F.array(F.lit(first), *tail, F.lit(1.0))
    counts = [F.col(prefix + c).cast("double") for c in CLASS_NAMES]
    if mode == "balanced":
        n = sum(counts[1:], counts[0])
        present = sum((F.when(c > 0, 1).otherwise(0) for c in counts[1:]), F.when(counts[0] > 0, 1).otherwise(0))
        return F.array(*[F.when(c > 0, n / (present * c)).otherwise(F.lit(1.0)) for c in counts])
    floor = [F.greatest(c, F.lit(1.0)) for c in counts]
    top = F.greatest(*floor)
    if mode == "balanced_sqrt":
        raw, cap = [F.sqrt(top / c) for c in floor], 10.0
    elif mode == "balanced_log":
        raw, cap = [F.log1p(top / c) for c in floor], 8.0
    else:
        raise ValueError(f"unknown class weight mode {mode!r}")
    return F.array(*[F.least(F.greatest(w, F.lit(0.5)), F.lit(cap)) for w in raw])


def weighted_rows(rows: DataFrame, mode: str, keys=(), y="y", name="weight") -> DataFrame:
    """Add each row's class weight; the weight table is five values per key and is broadcast."""
    table = class_counts(rows, keys, y).select(*keys, class_weights(mode).alias("_w"))
    side = F.broadcast(table)
    out = rows.join(side, list(keys)) if keys else rows.crossJoin(side)
    return out.withColumn(name, F.get("_w", F.col(y))).drop("_w")


def prior_bias(strength, prefix="count_") -> Column:
    """strength * log(uniform / prior), centred; counts are raised by one."""
    raised = F.array(*[F.col(prefix + c) + F.lit(1.0) for c in CLASS_NAMES])
    s = strength if isinstance(strength, Column) else F.lit(float(strength))
    bias = A.let(A.total(raised), lambda total: F.transform(
        raised, lambda c: s * F.log(F.lit(1.0 / N_CLASSES) / (c / total))))
    return A.let(bias, lambda v: A.let(A.mean(v), lambda m: F.transform(v, lambda b: b - m)))
