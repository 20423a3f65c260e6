"""Skyloom: a Spark-first engine for gridded, zonal and tabular analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that Spark ships to executors carry their code with them, so a
# cluster needs no copy of this package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
