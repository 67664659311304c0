"""Spark-native analytics over captures of web applications.

Tables go in, lazy DataFrames come out; see README.md for the layout.
"""

__version__ = "0.1.0"
