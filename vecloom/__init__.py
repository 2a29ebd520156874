"""vecloom: text-embedding analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the job, so that nothing has
# to be installed there and the working directory of a worker does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
