"""weftline: a PySpark-native analytics engine for research-network data."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: its functions travel with the tasks.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
