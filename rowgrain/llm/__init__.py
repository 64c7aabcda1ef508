"""Operators for preparing training data.  Nothing else in the library imports this subpackage.

Functions that run inside tasks are sent with the job, so executors need numpy, pyarrow and the tokenizers, but not
this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
