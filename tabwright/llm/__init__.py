"""Operators of a training-data pipeline.

Functions of this package that run in Python workers are shipped by value with the job, so the
workers need the listed libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
