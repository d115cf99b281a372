"""A PySpark-native engine for ordered key-value data and its change history."""
