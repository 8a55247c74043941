"""tidewheel: a PySpark-native engine for content-digest analytics."""
