"""Operators for training-data pipelines over ``documents``, ``benchmark``, ``labels`` and ``pages``.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator. Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value, so that
# executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
