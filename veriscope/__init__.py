"""Spark-native analytics for vector representations and for the data they are trained on."""

import os as _os
import sys as _sys

_ROOT = _os.path.dirname(_os.path.dirname(_os.path.abspath(__file__)))
if _ROOT not in _os.environ.get("PYTHONPATH", "").split(_os.pathsep):
    # Executors that cannot import this package get its functions with the tasks.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
