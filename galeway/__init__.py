"""Directional landscape connectivity and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
