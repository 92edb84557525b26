"""Operators for training-data pipelines.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so workers need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
