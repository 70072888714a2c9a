"""Operators for preparing large text corpora; nothing else in the library imports this package.

Functions sent to executors carry this package's code with them, so that executors need
not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
