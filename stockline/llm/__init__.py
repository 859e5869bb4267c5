"""Operators of a training-data pipeline over document, label and embedding tables.

Nothing outside this package imports it. The functions that run inside Spark tasks are pickled by
value, so executors need only the third-party libraries, not this repository.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
