"""Spark-native tables, sequences and benchmark scoring for grouped sequence data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
