"""Operators of a large-scale training-data pipeline.

Worker functions go to executors by value, as these need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
