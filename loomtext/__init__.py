"""loomtext: a PySpark-native engine for large collections of serial text."""
