"""Operators of a training-data pipeline over documents and pages."""

import sys

from pyspark import cloudpickle

# Tasks get the code of these modules with their functions, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
