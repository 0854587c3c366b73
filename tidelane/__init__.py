"""Spark-first operators for irregular time series, and a corpus-preparation subpackage (``llm``)."""
