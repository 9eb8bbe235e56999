"""siltstone: a PySpark-native analytics engine for data lakes queried by path."""
