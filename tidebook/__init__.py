"""Market-data and trading analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry the library's small helpers with them, so executors need
# no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
