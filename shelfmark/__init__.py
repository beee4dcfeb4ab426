"""Catalogue metadata of many databases as Spark DataFrames."""

__version__ = "0.1.0"
