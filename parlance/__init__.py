"""Spark DataFrame operators for multi-workspace document, terminology and review analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with the job, so the package need not
# be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
