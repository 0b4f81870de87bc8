"""wordkiln: text analytics on Spark. Everything is a lazy DataFrame transform or a column expression."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions and classes travel to the workers by value: executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
