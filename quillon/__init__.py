"""Quillon: a PySpark library for evidence-backed catalogue records and text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
