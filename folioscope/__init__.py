"""Folioscope: document analytics and evidence retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
