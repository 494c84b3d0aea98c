"""Low-renewable-event analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
