"""Admission, fan-out, aggregation, transformations and rollups, as functions of DataFrames."""
