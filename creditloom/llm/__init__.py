"""Operators for large training-text corpora; nothing else in the library imports them.

Functions of this package travel to the executors with each job, so it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
