"""Array expressions: resampling, differences, sums, windows over a series column."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression used inside a lambda is otherwise evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x)


def mean_abs(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.size(x)


def pop_std(x: Column) -> Column:
    """Population standard deviation by the two-pass formula."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def diff(x: Column) -> Column:
    """First difference, one element shorter than the input."""
    return let(x, lambda v: F.zip_with(
        F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: a - b
    ))


def zone(x: Column, lo: int, hi: int) -> Column:
    """Elements lo..hi-1 (0-based), clipped to the array."""
    lo = max(lo, 0)
    return F.slice(x, lo + 1, max(hi - lo, 0))


def argmax(x: Column) -> Column:
    """0-based index of the first largest element."""
    return let(x, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def argmin(x: Column) -> Column:
    return let(x, lambda v: (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def resample(x: Column, points: int) -> Column:
    """Linear resampling to ``points`` values on the normalised axis [0, 1]."""
    def on(v):
        m = F.size(v)

        def at(k):
            def lerp(pos):
                left = F.least(F.floor(pos).cast("int"), m - 1)
                a, b = F.get(v, left), F.get(v, F.least(left + 1, m - 1))
                return a + (b - a) * (pos - left)

            return let(k * (m - 1) / F.lit(float(max(points - 1, 1))), lerp)

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    return let(x, on)


def patches(x: Column, width: int, stride: int) -> Column:
    """Overlapping windows of ``width`` every ``stride`` values; a short tail is dropped."""
    starts = F.sequence(F.lit(0), F.size(x) - width, F.lit(stride))
    return F.when(
        F.size(x) >= width, F.transform(starts, lambda s: F.slice(x, s + 1, F.lit(width)))
    ).otherwise(F.array().cast("array<array<double>>"))


def moving_average(x: Column, kernel: int = 25) -> Column:
    """Centred moving average with the edge values replicated ``kernel//2`` times."""
    pad = (kernel - 1) // 2
    padded = F.concat(
        F.array_repeat(F.get(x, F.lit(0)), pad), x, F.array_repeat(F.element_at(x, -1), pad)
    )
    return let(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p) - 2 * pad),
        lambda i: total(F.slice(p, i, F.lit(kernel))) / F.lit(float(kernel)),
    ))


def average_pool(x: Column, width: int = 2) -> Column:
    """Non-overlapping averages of ``width`` values; a short tail is dropped."""
    last = F.floor(F.size(x) / width).cast("int")
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: total(F.slice(x, i * width + 1, F.lit(width))) / F.lit(float(width)),
        ),
    ).otherwise(F.array().cast("array<double>"))


def instance_norm(x: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / (sample std + eps) within one series."""
    def scaled(m):
        ss = total(F.transform(x, lambda v: (v - m) * (v - m)))
        return let(F.sqrt(ss / (F.size(x) - 1)) + F.lit(eps),
                   lambda sd: F.transform(x, lambda v: (v - m) / sd))

    return let(mean(x), scaled)


def lead_summary(b0: Column, b1: Column) -> Column:
    """14 values: seven summaries of the lead difference, then of the lead sum."""

    def seven(x):
        return let(x, lambda a: F.array(
            mean(a), pop_std(a), mean_abs(a), F.array_max(a), F.array_min(a),
            F.array_max(a) - F.array_min(a), mean_square(diff(a))))

    minus = F.zip_with(b0, b1, lambda x, y: x - y)
    plus = F.zip_with(b0, b1, lambda x, y: x + y)
    return F.concat(seven(minus), seven(plus))


def flat_leads(b0: Column, b1: Column) -> Column:
    return F.concat(b0, b1)


def stack_leads(b0: Column, b1: Column, mode: str = "dual") -> Column:
    if mode == "single":
        return F.array(b0)
    if mode == "dual":
        return F.array(b0, b1)
    raise ValueError(f"unknown lead mode {mode!r}")
