"""Training-data pipeline operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get this code with each task, so they need no copy on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
