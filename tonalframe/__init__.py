"""Symbolic-music and corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
