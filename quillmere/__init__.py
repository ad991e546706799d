"""Spark-native document analytics and retrieval engine.

Worker-side functions of this package are shipped by value, so that executors need no
copy of the package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
