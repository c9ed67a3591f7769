"""Network-flow analytics on Spark: packets to flows, flow scoring, metrics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
