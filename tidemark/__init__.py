"""tidemark: versioned nested state, deltas and training-data operators on Spark DataFrames.

Functions of this package are shipped to Python workers by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
