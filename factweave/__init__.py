"""A PySpark-native engine for structured clinical facts."""
