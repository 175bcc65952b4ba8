"""Code-corpus indexing, answer contracts and crash triage as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
