"""Operators on DataFrames: normalize, detect, correlate, score, alert, check."""
