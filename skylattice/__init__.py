"""A PySpark-native analytics engine for astronomical data and large text corpora."""

__version__ = "0.1.0"
