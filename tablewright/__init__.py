"""Spark-native analysis of one table of any size.

Every operator is a plain function on a DataFrame.  Results stay lazy
DataFrames unless an operator needs a handful of statistics first (a minimum, a
mean, a fence); those come back to the driver as one bounded row.
"""

from tablewright.dataset import Dataset

__all__ = ["Dataset"]
