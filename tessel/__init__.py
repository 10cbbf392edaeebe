"""Segment-selection analytics and table helpers on PySpark DataFrames."""
