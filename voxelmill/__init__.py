"""Quantitative image analytics and corpus preparation as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships carry their code along, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
