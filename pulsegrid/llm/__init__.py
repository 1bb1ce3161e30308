"""Training-data operators.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
