"""Company and leadership resolution as DataFrame operators."""
import sys

from pyspark import cloudpickle

# Python stages travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
