"""A PySpark-native engine around lazy, statically typed datasets."""
