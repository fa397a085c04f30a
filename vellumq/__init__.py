"""vellumq: a Spark-first engine for searching and analysing document collections."""

__version__ = "0.1.0"
