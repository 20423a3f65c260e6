"""Operators for large text corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to executors carry their code with them, so a
# cluster needs no copy of this package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
