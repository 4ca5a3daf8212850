"""A small PySpark-native analytics engine: lazy ``DataFrame -> DataFrame`` operators."""
