"""placewright: Spark-native analytics for local-business records."""

__version__ = "0.1.0"
