"""Capture analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; the columns that
partition, order and identify the rows are arguments, so the same code serves
photo shoots, event logs and embedding tables.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
