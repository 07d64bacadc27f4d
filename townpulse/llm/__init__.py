"""Operators for training data at corpus scale; nothing else in the library imports them.

Functions that run in tasks travel with the job, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
