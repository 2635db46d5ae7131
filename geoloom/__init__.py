"""A PySpark-native engine for feature tables: typed attributes and 2D geometry.

Functions of this package are shipped to the executors by value, so executors
do not need it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
