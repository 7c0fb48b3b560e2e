"""A PySpark-native engine for record discovery, matching and registries."""
