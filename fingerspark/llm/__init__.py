"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage. Worker functions travel to the
executors by value, so the executors need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
