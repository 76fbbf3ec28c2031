"""A PySpark-native engine that generates, encodes, reshapes, writes and measures benchmark tables."""
