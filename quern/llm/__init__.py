"""Training-data operators: near-duplicates, quality, decontamination, mixing,
sharding, search, URL rules, chat and passage deduplication.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
