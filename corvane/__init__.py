"""Corvane: repository-intelligence analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
