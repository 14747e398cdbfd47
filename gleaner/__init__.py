"""gleaner: build and judge text-retrieval datasets with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
