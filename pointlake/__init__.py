"""Retrieval and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a worker
# needs no copy of the package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
