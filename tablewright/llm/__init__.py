"""Operators for preparing training text at scale; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the tasks, so executors need not have the library on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
