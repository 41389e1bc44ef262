"""Review analytics as composable PySpark DataFrame operators.

Functions of this package that run inside executors are pickled by value, so a cluster's workers need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
