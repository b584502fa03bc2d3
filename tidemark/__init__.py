"""tidemark: text search, ranking, link analysis and text mining on PySpark DataFrames."""

__version__ = "0.1.0"
