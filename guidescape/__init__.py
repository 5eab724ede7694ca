"""Grouped enrichment, set comparison and differential testing on Spark DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their code with them, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
