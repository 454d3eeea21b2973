"""Operators for training-data pipelines; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
