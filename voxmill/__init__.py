"""Voxmill: array loading, augmentation and corpus preparation as Spark plans.

Samples are rows, tensors are flat array columns with a shape known when the
plan is built, and every transform returns a new DataFrame.  Functions that
Python workers run are shipped by value, so executors don't need the package
installed.
"""

from __future__ import annotations

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
