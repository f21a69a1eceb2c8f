"""A PySpark-native analytics engine for multi-view tracking data."""
