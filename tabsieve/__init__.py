"""Wide-table data quality, leakage-safe preprocessing and classifier evaluation on Spark."""

import sys

from pyspark import cloudpickle

# Vectorised helpers travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
