"""Operators. What they run in tasks travels by value, so that workers need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
