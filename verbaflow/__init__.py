"""A PySpark-native engine for multilingual text analytics and for preparing language-model training data."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Executors need no copy of this package: functions defined in it travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
