"""coreloom: core-set selection, compression and similarity checks on Spark."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
