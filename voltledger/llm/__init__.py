"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Executors get the task functions of this package with the job; it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
