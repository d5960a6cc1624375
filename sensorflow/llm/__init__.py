"""Operators for large training corpora. Nothing outside this package imports it.

Functions that run on executors are sent with the job, so executors need only
the installed libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
