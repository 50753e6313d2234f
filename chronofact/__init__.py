"""Bitemporal fact analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
