"""Operators of a training-data pipeline; each module holds one of them, `queries` registers them.

Functions that run in Python workers travel with the plan, so the package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
