"""lectern: catalogue, document and planning analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python code that runs on executors travels with the plan, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
