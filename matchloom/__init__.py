"""Record linkage and data processing on Spark: normalization, blocking, comparison, scoring, selection, routing."""

import sys

from pyspark import cloudpickle

# functions of this package that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
