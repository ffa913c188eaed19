"""strata: a layered query-routing cascade and its analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (and rule tables) and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
