"""Operators of a training-data pipeline, their queries and the SQL they are checked against."""

import sys

from pyspark import cloudpickle

from .catalog import ORACLES, QUERIES
from . import (  # noqa: F401
    clusters,
    exact_dedup,
    fill_middle,
    language,
    licenses,
    line_dedup,
    mixing,
    packing,
    personal,
    quality,
    simhash,
    toxicity,
    warc,
)

# Tasks carry this code with them, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLES", "QUERIES"]
