"""Operators for training-data pipelines: filtering, deduplication, scanning, sharding and packing of documents."""

import sys

from pyspark import cloudpickle

# functions for tasks travel whole, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
