"""Operators for training-data corpora: documents, vectors and their near copies.

Functions of this package travel to the workers by value, so that executors
need numpy and Arrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
