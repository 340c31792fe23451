"""Spark-native analytics for coding sequences, protein records and the corpora around them."""

__version__ = "0.1.0"
