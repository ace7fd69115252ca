"""Tessera: product, revenue and evidence analytics as PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
