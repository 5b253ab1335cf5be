"""tabassay: examine any table with Spark and say what is in it and what looks wrong."""

import sys

from pyspark import cloudpickle

from .plans.analysis import Analysis
from .sources.csv import read_csv
from .sources.table import Table, read_parquet, read_table

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Analysis", "Table", "read_csv", "read_parquet", "read_table"]
