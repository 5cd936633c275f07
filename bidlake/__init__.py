"""Tender document retrieval and graph analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from bidlake.session import build_session

# Task functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
