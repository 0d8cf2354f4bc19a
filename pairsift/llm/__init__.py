"""Operators that prepare text, pages and vectors for model training, as Spark jobs."""
