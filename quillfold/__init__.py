"""Spark-first analytics for building, curating and evaluating corpora of long documents."""
