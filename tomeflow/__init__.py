"""tomeflow: retrieval, summary auditing and corpus processing for long-form text on PySpark."""

__version__ = "0.1.0"
