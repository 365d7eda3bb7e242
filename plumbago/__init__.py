"""plumbago: a Spark-first engine for dataset engineering, score analytics and vector retrieval."""

__version__ = "0.1.0"
