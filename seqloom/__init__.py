"""A Spark-native engine for mapping query sequences onto reference sequences."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers as code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
