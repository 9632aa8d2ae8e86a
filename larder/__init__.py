"""larder: set-oriented analytics for product catalogues on Spark DataFrames."""

__version__ = "0.1.0"
