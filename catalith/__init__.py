"""Spark-native engine for media catalogues: relational operators and training-data preparation."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
