"""Training-data operators; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this subpackage with them, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
