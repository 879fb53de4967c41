"""Operators of a training-data pipeline; nothing else in the package imports this one.

Functions of these modules that run in Python workers travel by value, so executors need no copy
of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
