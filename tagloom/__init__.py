"""tagloom: prompt tagging, tag normalization and model routing as PySpark DataFrame jobs."""

__version__ = "0.1.0"
