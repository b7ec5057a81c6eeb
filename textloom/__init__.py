"""Corpus-grounded retrieval analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
