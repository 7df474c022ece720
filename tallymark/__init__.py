"""Rule-based labelling, audit and dense counting over Spark DataFrames."""

__version__ = "0.1.0"
