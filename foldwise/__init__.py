"""Fold-safe scoring, profiling and calibration jobs on Spark DataFrames."""
