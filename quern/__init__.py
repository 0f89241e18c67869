"""Quern: a PySpark-native analytics engine."""
