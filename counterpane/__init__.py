"""Counterfactual analytics over panels of multivariate time series, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task closures carry this package's functions by value, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
