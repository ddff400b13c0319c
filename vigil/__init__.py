"""vigil — telemetry and payment-event analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so the workers need
# neither this package on their path nor a particular working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
