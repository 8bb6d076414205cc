"""riskloom: Spark operators for tables with a binary outcome."""

import sys

from pyspark import cloudpickle

# The package's few vectorised functions travel with their tasks, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
