"""A PySpark-native engine for ordered financial and event series."""
