"""Group size checks shared by the operators that must keep a group in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 1_000_000


def largest_group(df: DataFrame, keys) -> int:
    """Rows in the largest group: one partial aggregate, one number to the driver."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)
