"""Posting and web-document curation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from gleaner.config import Config, Criteria

__all__ = ["Config", "Criteria"]

# Tasks carry the helpers they use, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
