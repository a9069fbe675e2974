"""Tidewire: a news-intelligence and text-data engine on PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run on executors travel with their code, so a cluster needs no copy of this package.
register_pickle_by_value(sys.modules[__name__])
