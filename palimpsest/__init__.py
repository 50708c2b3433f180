"""Spark-native operators for long-lived agent memory: recall, arbitration, consolidation, graph and stream analytics."""

import sys

from pyspark import cloudpickle

# Functions given to Spark travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
