"""Sky-map analytics on Spark. Functions that run in Python workers travel by value: workers need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
