"""lodestrata: a Spark-first engine for analysing source-code and document corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so that they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
