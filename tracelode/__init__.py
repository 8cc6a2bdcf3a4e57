"""Spark-first engine for finding and measuring evidence in document collections."""
