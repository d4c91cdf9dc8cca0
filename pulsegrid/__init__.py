"""Batch analytics for annotated time series, written as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with the plan, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
