"""Spark jobs over the supplied test tables."""
