"""lumenframe: hybrid moment retrieval and corpus processing as Spark DataFrame plans."""

__version__ = "0.1.0"
