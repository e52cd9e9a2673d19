"""A Spark-first engine for property graphs of knowledge."""
