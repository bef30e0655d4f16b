"""A PySpark-native analytics engine for heterogeneous sensor time series."""

__version__ = "0.1.0"
