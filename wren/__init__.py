"""wren: post analytics on Spark.

Python functions that run inside tasks (``mapInPandas`` folds, the state
function of the streaming admission, user hooks) are shipped by value, so
executors do not need this package installed: registering the package with
PySpark's cloudpickle makes it serialize these functions and the library
helpers they call instead of importing ``wren`` on the workers.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
