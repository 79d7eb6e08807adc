"""Point-in-time market and news research operators on Spark DataFrames."""

__version__ = "0.1.0"
