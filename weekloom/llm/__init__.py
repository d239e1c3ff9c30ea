"""Training-data operators. Nothing outside this package imports it.

Functions that run in Python workers are shipped by value, so executors need
numpy, pyarrow and the tokenizer files, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
