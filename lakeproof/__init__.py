"""Checking and planning large data moves with Spark DataFrames."""

__version__ = "0.1.0"
