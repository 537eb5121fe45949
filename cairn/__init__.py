"""A PySpark-native engine for knowledge memory and corpus preparation."""
