"""wordloom: exact analysis and compression of numeric tensor streams on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
