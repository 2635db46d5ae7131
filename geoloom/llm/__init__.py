"""Operators for preparing training text: ten self-contained operators and their queries.

Nothing outside this package imports it.  Its functions are shipped to the
executors by value, so the executors do not need the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
