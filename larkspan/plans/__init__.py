"""Whole queries built from the tables."""
