"""Millrace: a PySpark-native code-facts and corpus analytics engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
