"""Tidemark: cleaning, windowing and anomaly scoring of sensor telemetry on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to the Python workers carry this package with them, so a job
# needs no --py-files and no particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
