"""plumbline: document retrieval and corpus analytics as ordinary Spark plans."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: those need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
