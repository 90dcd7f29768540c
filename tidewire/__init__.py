"""Incremental content analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel inside the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
