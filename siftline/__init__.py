"""Spark-native engine for curating, auditing and evaluating text datasets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# batch functions go to the workers by value, so that these need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
