"""merganser: record linkage, merging and corpus preparation as PySpark DataFrames."""

__version__ = "0.1.0"
