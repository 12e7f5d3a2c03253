"""palimpsest: Spark jobs for preparing and evaluating rewritten-text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing is to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
