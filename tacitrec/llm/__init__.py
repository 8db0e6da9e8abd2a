"""Operators that prepare text corpora for training. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Executors need not have this folder: the functions they run travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["tacitrec"])
