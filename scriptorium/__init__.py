"""Corpus analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
