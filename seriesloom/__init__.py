"""Keyed time-series preparation, forecast evaluation and strategy analysis on Spark DataFrames."""

__version__ = "0.1.0"
