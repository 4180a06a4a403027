"""Operators for preparing training text, each one a Spark job.

Nothing else of the library imports this subpackage.  Its functions travel to
the workers by value, so executors need numpy, pyarrow and (for packing) the
tokenizers library, but not this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
