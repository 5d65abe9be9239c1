"""Reference-data analytics on Spark DataFrames: similarity, selection, consensus and evaluation."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
