"""Operators that prepare text corpora for language-model training.

Their functions travel to the executors by value: a job needs no copy of this package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
