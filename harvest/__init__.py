"""Clean records out of tables of fetched web pages, as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
