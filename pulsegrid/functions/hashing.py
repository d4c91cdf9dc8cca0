"""Portable hash randomness: the same draw in Spark, in SQL and on every partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2 ** 32


def _text(part):
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash32(*parts) -> Column:
    """Leading 32 bits of md5 over the '|'-joined parts, as a long in [0, 2**32)."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(*parts) / F.lit(float(SPAN))


def normal(*parts) -> Column:
    """Standard normal draw by the Box-Muller formula on two hashes."""
    u1 = (hash32(*parts, "a") + F.lit(0.5)) / F.lit(float(SPAN))
    u2 = uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
