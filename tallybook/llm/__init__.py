"""Operators that prepare text, vectors and pages for training a language model.

Nothing else in the library imports this package.  Functions that run inside
tasks travel with the job, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
