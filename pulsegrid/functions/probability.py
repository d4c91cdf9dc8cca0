"""Row operations on five-class probability arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.schema import N_CLASSES

EPS = 1e-12
LOG_FLOOR = 1e-8


def normalise(p: Column) -> Column:
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(EPS)))
    return A.let(clipped, _divide_by_total)


def _divide_by_total(v: Column) -> Column:
    return A.let(F.greatest(A.total(v), F.lit(EPS)), lambda s: F.transform(v, lambda x: x / s))


def power_calibrate(p: Column, power) -> Column:
    """Normalise, raise to ``power`` and normalise again; power 1 only normalises."""
    if isinstance(power, Column):
        return A.let(normalise(p), lambda base: F.when(F.abs(power - 1.0) < EPS, base).otherwise(
            normalise(F.transform(base, lambda x: F.pow(x, power)))))
    base = normalise(p)
    if abs(float(power) - 1.0) < EPS:
        return base
    return normalise(F.transform(base, lambda x: F.pow(x, F.lit(float(power)))))


def align(by_class: Column) -> Column:
    """Map class -> probability to a full row; an all-zero row becomes uniform."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
        lambda c: F.coalesce(F.element_at(by_class, c), F.lit(0.0)),
    )
    uniform = F.array(*[F.lit(1.0 / N_CLASSES)] * N_CLASSES)
    return normalise(A.let(raw, lambda r: F.when(A.total(r) <= 0, uniform).otherwise(r)))


def softmax(scores: Column) -> Column:
    def shifted(v):
        return A.let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    return A.let(A.let(scores, shifted), _divide_by_total)


def align_scores(by_class: Column) -> Column:
    """Map class -> decision score to probabilities; a class without score gets -1e6."""
    return softmax(
        F.transform(
            F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
            lambda c: F.coalesce(F.element_at(by_class, c), F.lit(-1e6)),
        )
    )


def binary_scores(score: Column, negative: int, positive: int) -> Column:
    """A single two-class decision score as a class -> score map."""
    return F.create_map(F.lit(negative), -score, F.lit(positive), score)


def near_one_hot(label: Column, background: float = 1e-6) -> Column:
    row = F.transform(
        F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
        lambda c: F.when(c == label, F.lit(1.0)).otherwise(F.lit(background)),
    )
    return A.let(row, _divide_by_total)


def safe_log(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(LOG_FLOOR)), F.lit(1.0))))


def fuse_logs(log_a: Column, log_b: Column, alpha) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(log_a, log_b, lambda x, y: (F.lit(1.0) - a) * x + a * y)


def fuse(backbone: Column, evidence: Column, alpha) -> Column:
    """Log-linear fusion of two probability rows."""
    return softmax(fuse_logs(safe_log(backbone), safe_log(evidence), alpha))


def boundary_scores(log_b, log_e, bias, alpha, tau, eta) -> Column:
    """Fused scores plus bias, pushed along the evidence where the top two are close."""
    alpha, tau, eta = [v if isinstance(v, Column) else F.lit(float(v)) for v in (alpha, tau, eta)]
    scores = F.zip_with(fuse_logs(log_b, log_e, alpha), bias, lambda x, b: x + b)

    def push(v):
        ranked = F.sort_array(v, asc=False)
        margin = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
        weight = F.when(
            eta > 0, eta * F.exp(-margin / F.greatest(tau, F.lit(1e-6)))
        ).otherwise(F.lit(0.0))
        return A.let(F.struct(weight.alias("w"), A.mean(log_e).alias("c")), lambda k: F.zip_with(
            v, log_e, lambda s, e: s + k["w"] * (e - k["c"])))

    return A.let(scores, push)


def decision_scores(p: Column, power, multiplier: Column) -> Column:
    return F.zip_with(power_calibrate(p, power), multiplier, lambda x, m: x * m)


def decode(p: Column, power, multiplier: Column) -> Column:
    """Class with the largest powered probability times multiplier, first on ties."""
    return A.argmax(decision_scores(p, power, multiplier))
