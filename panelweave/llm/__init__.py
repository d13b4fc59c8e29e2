"""Operators for preparing language-model training data, each a Spark job over whole tables.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
