"""Outline sheets to hierarchy tables, and near-duplicate names inside them, on Spark."""

import sys

from pyspark import cloudpickle

from kinsheet.plans.flatten import FlattenResult, flatten_hierarchy
from kinsheet.plans.report import ordered_results, result_table, snapshot
from kinsheet.plans.runs import directed_run, flatten_run, similarity_run
from kinsheet.plans.similar import find_similar, similarity_job

__all__ = [
    "FlattenResult",
    "directed_run",
    "find_similar",
    "flatten_hierarchy",
    "flatten_run",
    "ordered_results",
    "result_table",
    "similarity_job",
    "similarity_run",
    "snapshot",
]

# Functions that run in Python workers travel with the job instead of being imported there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
