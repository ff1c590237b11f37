"""Panel analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the functions they run by value, so they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
