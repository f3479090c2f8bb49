"""A PySpark-native analytics engine for panel time series."""
