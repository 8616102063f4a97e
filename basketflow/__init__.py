"""basketflow: recommendation data work over retail lines, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The small NumPy helpers travel with the tasks that use them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
