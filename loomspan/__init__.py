"""loomspan: corpus processing and terminology analytics as Spark DataFrames."""

__version__ = "0.1.0"
