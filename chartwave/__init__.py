"""chartwave: a PySpark-native engine for chart traces, signals and training text.

Every operator takes and returns DataFrames.  Functions that run inside Python
tasks are shipped by value, so executors need PySpark, numpy, pandas and
pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
