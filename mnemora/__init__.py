"""Mnemora: recall analytics over text memories, chat logs and graphs, on Spark.

Functions that run inside Python workers are pickled by value, so a job needs no copy of
this package on its executors.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
