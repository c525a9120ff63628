"""PySpark-native text-corpus analytics: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
