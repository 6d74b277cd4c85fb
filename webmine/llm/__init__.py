"""Operators of a large-scale training-data pipeline (deduplication, packing, mixing, extraction, scoring, archives).

Nothing outside this subpackage imports it. Code that runs in Python workers is shipped by value, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
