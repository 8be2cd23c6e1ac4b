"""Turn documents and tables into governed facts, and facts into report tables, on Spark."""

__version__ = "0.1.0"
