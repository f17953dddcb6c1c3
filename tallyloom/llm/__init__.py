"""Operators for preparing training text at scale; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
