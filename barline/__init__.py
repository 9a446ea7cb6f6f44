"""barline: market time-series analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# small worker-side functions travel with the task, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
