"""themeloom: theme maps of large text collections, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside tasks travel with them, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
