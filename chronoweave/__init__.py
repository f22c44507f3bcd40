"""Search and merge log files by datetime on Spark."""

__version__ = "0.1.0"
