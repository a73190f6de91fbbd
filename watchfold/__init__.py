"""Security and fraud analytics as functions from DataFrame to DataFrame.

Every operator is a lazy Spark plan; nothing here starts a job except where a
docstring says so (reading a bounded term list, fitting a model, running a stream).
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
