"""Functions of this package that run in Python workers are sent by value, so
the workers need not have the package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
