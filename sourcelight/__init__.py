"""Evidence analytics over document collections, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so neither executors nor the
# workers that set up stateful streams need it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
