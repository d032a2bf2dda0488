"""Spark-native code-graph analytics: every operator is a DataFrame-to-DataFrame function."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
