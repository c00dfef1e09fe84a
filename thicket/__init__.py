"""thicket: extreme multi-label learning and training-data analytics on Spark DataFrames.

Functions that run in Python workers are pickled by value, so executors need
PySpark, pyarrow and numpy but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
