"""Security-telemetry analytics on Spark: detect, correlate, score, alert, query."""

import sys

from pyspark import cloudpickle

# The Arrow kernels travel to the workers by value, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
