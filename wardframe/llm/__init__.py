"""Operators for large training corpora.  Nothing else in the library imports
this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need not have the library installed: functions of this subpackage
# travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
