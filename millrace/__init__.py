"""millrace: a Spark-native engine for batch and streaming analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the task, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
