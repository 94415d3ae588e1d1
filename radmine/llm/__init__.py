"""Training-data pipeline operators (corpus cleaning, mixing, tokenizing, archives).

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""

import sys

from pyspark import cloudpickle

# Executors get these functions by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
